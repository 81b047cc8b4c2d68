"""Small tables with nulls, empty and long texts, ties, copies and clashing columns, against brute force."""

import hashlib
import random
import time
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickflow.llm import common, decontaminate, html, language, line_dedup, ngram_join, pii, suffix_dedup, toxicity

EXTRA = "id long, keys string, sig string, text2 string, n_shingles int"


def docs_of(spark, texts, key="doc_id"):
    """Documents with further columns whose names the operators use inside."""
    rows = [(i, t, i * 2, "k", "s", "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"{key} long, text string, {EXTRA}").repartition(3)


def words(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()


def sample_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n ", "One", "one", "two words", "two words", "ÀÉ été"]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):  # near copies of several degrees
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    texts.append(texts[-1] + " tail")
    return texts


# --- n-gram join -----------------------------------------------------------


def brute_classes(texts, width, num, den):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j]:
                k = len(x & sets[j])
                if den * k >= num * (len(x) + len(sets[j]) - k):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width,num,block", [(3, 90, 256), (5, 80, 256), (3, 80, 4)])
def test_ngram_join(spark, width, num, block):
    texts = sample_texts()
    got = ngram_join.near_duplicates(docs_of(spark, texts), width=width, num=num, den=100, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_classes(texts, width, num, 100)


def test_ngram_join_candidates_do_not_chain_by_single_passages(spark, monkeypatch):
    """Texts that share one passage of five words with the next one are no candidates, so none is compared."""
    rng = random.Random(3)
    own = [[f"v{rng.randrange(10**9)}" for _ in range(20)] for _ in range(120)]
    texts = [" ".join(a + b[:5]) for a, b in zip(own, own[1:] + own[:1])]
    texts.append(texts[0] + " tail")
    placed = []
    links = ngram_join.cell_links

    def count(docs, there, *args):
        placed.append(there.count())
        return links(docs, there, *args)

    monkeypatch.setattr(ngram_join, "cell_links", count)
    got = ngram_join.near_duplicates(docs_of(spark, texts), width=5, num=80, den=100, block=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_classes(texts, 5, 80, 100)
    assert sum(placed) <= 4


def test_ngram_join_common_tokens(spark, monkeypatch):
    """Tokens of more rows than a task holds are streamed; each set has each of them once."""
    rows = [(k, s) for k in (-5, 3, 9) for s in range(40) for _ in range(1 + s % 3)] + [(4, 1), (4, 1), (5, 1), (5, 2)]
    tokens = spark.createDataFrame(rows, "k long, sig long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(ngram_join, "HELD", 20)
    try:
        got = sorted((r.k, r.sig, r.df) for r in ngram_join.shared_tokens(tokens).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == sorted([(k, s, 20) for k in (-5, 3, 9) for s in range(40)] + [(5, 1, 2), (5, 2, 2)])


def test_ngram_join_empty_table(spark):
    assert ngram_join.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_size_classes_reach_all_partners():
    for num, den in ((90, 100), (80, 100)):
        c = ngram_join.Classes(num, den)
        for n in range(1, 400):
            for m in range(n, n * den // num + 1):
                assert set(c.labels(n)) & set(c.labels(m)), (n, m)
                k = n + m - 2 * -(-num * (n + m) // (num + den))  # most differing tokens
                label = max(set(c.labels(n)) & set(c.labels(m)))
                parts, free = c.parts(c.of(n))
                assert k <= 0 or parts >= k + 1 + free, (n, m, label)


# --- line dedup --------------------------------------------------------------


def brute_lines(texts, num, den, least):
    seen, gone = [], set()
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if len(s) < least:
                continue
            if any(den * len(s & o) >= num * len(s | o) for o in seen):
                gone.add((i, n))
            seen.append(s)
    return gone


def test_line_dedup_fetches_only_texts_with_wanted_lines(spark, monkeypatch):
    """Texts without candidate lines are left out before the texts are joined with the wanted lines."""
    rng = random.Random(9)
    texts = [" ".join(f"v{rng.randrange(10**9)}" for _ in range(12)) for _ in range(60)]
    texts += [f"{texts[0]} more", f"{texts[1]} more"]
    fetched = []
    near = line_dedup.only_near

    def count(docs, placed):
        kept = near(docs, placed)
        fetched.append(kept.count())
        return kept

    monkeypatch.setattr(line_dedup, "only_near", count)
    found = line_dedup.repeated_lines(docs_of(spark, texts), block=4)
    assert {tuple(r) for r in found.collect()} == brute_lines(texts, 80, 100, 5) == {(60, 0), (61, 0)}
    assert fetched == [4]


def test_line_dedup_long_lines_do_not_chain(spark, monkeypatch):
    """Long lines that share some words are no candidates: their parity bits do not saturate."""
    rng = random.Random(12)
    pool = [f"v{rng.randrange(10**9)}" for _ in range(4000)]
    lines = [rng.sample(pool, n) for n in (300, 700, 120) for _ in range(16)]
    texts = [" ".join(x) for x in lines] + [" ".join(x[5:] + ["tail"]) for x in lines[::8]]
    fetched = []
    near = line_dedup.only_near

    def count(docs, placed):
        fetched.append(placed.count())
        return near(docs, placed)

    monkeypatch.setattr(line_dedup, "only_near", count)
    found = line_dedup.repeated_lines(docs_of(spark, texts))
    assert {tuple(r) for r in found.collect()} == brute_lines(texts, 80, 100, 5) == {(k, 0) for k in range(48, 54)}
    assert fetched == [12]


def test_line_dedup_parity_bounds_the_difference():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 5, 64, 65, 160, 161, 400, 401, 900, 901, 3000, 40])
    pool = rng.integers(0, 1 << 44, 4000, dtype=np.uint64)
    sets = [rng.choice(pool, n, replace=False) for n in sizes]
    words, begin = line_dedup.parity(np.concatenate(sets), sizes)
    assert np.diff(begin).tolist() == [1, 1, 1, 2, 2, 4, 4, 8, 8, 16, 16, 1]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            least = min(begin[i + 1] - begin[i], begin[j + 1] - begin[j])
            w = 1
            while w <= least:
                got = line_dedup.differing((words[begin[i] : begin[i] + w] ^ words[begin[j] : begin[j] + w])[None])[0]
                odd = np.bincount((common.mix(np.concatenate([x, y])) % np.uint64(64 * w)).astype(np.int64), minlength=64 * w) % 2
                assert got == odd.sum() <= len(set(x.tolist()) ^ set(y.tolist()))
                w *= 2


@pytest.mark.parametrize("block", [512, 4])
def test_line_dedup(spark, block):
    rng = random.Random(4)
    pool = [t for t in sample_texts(5, 25)[8:-2]]
    texts = [None, "", "\n\n", "short line\nshort line"]
    for _ in range(40):
        texts.append("\n".join(rng.choice(pool) + rng.choice(["", " more", " x y z"]) for _ in range(rng.randrange(1, 5))))
    texts.append(texts[-1])
    docs = docs_of(spark, texts)
    want = brute_lines(texts, 80, 100, 5)
    found = line_dedup.repeated_lines(docs, block=block)
    assert {tuple(r) for r in found.collect()} == want
    left = {r.doc_id: r.text for r in line_dedup.remove_lines(docs, found).collect()}
    for i, t in enumerate(texts):
        assert left[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want))


def test_line_dedup_judges_short_lines(spark, tmp_path):
    texts = [None, "", "one\n\ntwo words\nabc", " ABC \n\nwords two two\nnew", "a b c d", "a b c d e", "a b c", "a b", "每一行都是一个词\n  ", "每一行都是一个词", "e d c b", "x a b c d e f"]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_lines(texts, 80, 100, 1)
    assert (3, 0) in want and (5, 0) in want and (9, 0) in want and (6, 0) not in want
    got = {(r.doc_id, n) for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect() for n in r.removed}
    assert got == want
    left = corpus_pipeline.drop_repeated_lines(spark, docs_of(spark, texts), "")
    assert {r.doc_id for r in left.collect() if r.text is not None and not r.text.strip()} == {1, 5, 9, 10}


def test_line_dedup_empty_table(spark):
    assert line_dedup.repeated_lines(docs_of(spark, ["a"]).limit(0)).count() == 0


# --- suffix dedup ------------------------------------------------------------


def brute_suffix(texts, width):
    seen, out = set(), []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                cover[p : p + width] = b"\1" * width
            seen.add(w)
        left = bytes(c for c, z in zip(b, cover) if not z)
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_suffix_dedup(spark, block):
    rng = random.Random(7)
    alphabet = "abcdé "
    chunks = ["".join(rng.choice(alphabet) for _ in range(rng.choice([60, 99, 100, 101, 150, 400]))) for _ in range(12)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 200]
    for _ in range(60):
        texts.append("".join(rng.choice(chunks) if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(30)) for _ in range(4)))
    texts.append(texts[-1])
    docs = docs_of(spark, texts)
    got = suffix_dedup.remove_ranges(docs, suffix_dedup.repeated_ranges(docs, block=block), keep_text=False)
    assert sorted(tuple(r) for r in got.collect()) == brute_suffix(texts, 100)


def test_deep_shallow_order():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    strings += [s + b"tail" for s in strings[:50]] + strings[:20] + [b"a" * 40, b"a" * 41, b"a" * 40]
    assert [strings[i] for i in suffix_dedup.deep_shallow(strings)] == sorted(strings)


# --- decontamination -----------------------------------------------------------


def test_leaks_and_recall(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ar", "el", "in", "os", "ut", "ank", "ent")]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))) for _ in range(40)]
    texts, want = [None, "", "word"], set()
    for i, item in enumerate(items):
        for share in (0.0, 0.1, 0.18):
            w = item.split()
            for _ in range(int(share * len(w))):
                w[rng.randrange(len(w))] = "changed"
            noise = [rng.choice(vocabulary) for _ in range(200)]
            at = rng.randrange(200)
            want.add((len(texts), i))
            texts.append(" ".join(noise[:at] + [x.upper() for x in w] + noise[at:]))
    clean = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(60)]
    first_clean = len(texts)
    texts += clean
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(98, None, "x"), (99, "too short", "x")], "item_id long, text string, key string")
    got = decontaminate.find_leaks(docs_of(spark, texts), benchmark).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(want & pairs) >= 0.95 * len(want)
    assert all(r.doc_id < first_clean for r in got)
    assert all(r.distance <= int(0.2 * len(items[r.item_id].split())) for r in got)
    assert {p for p in want if (p[0] - 3) % 3 == 0} <= pairs  # exact passages are all found


def test_leaks_of_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs_of(spark, ["a b c"]), none).count() == 0


def test_edit_distance_against_table():
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.choice("abcd") for _ in range(rng.randrange(2, 12))]
        text = [rng.choice("abcde") for _ in range(rng.randrange(0, 20))]
        ix = decontaminate.Index([0], [" ".join(item)], 0.2, 1, 2, 1)
        code = {w: int(c) for w, c in zip(item, ix.items[0])}
        import numpy as np

        d, _ = ix.distance(0, np.array([code.get(w, -1) for w in text], np.int64))
        row = [0] * (len(text) + 1)
        for i, w in enumerate(item):
            new = [i + 1]
            for j, x in enumerate(text):
                new.append(min(row[j] + (w != x), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert d == min(row)


# --- personal data -------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    texts = [
        "a@b.c", "@b.c a@", "x..y%@host.example.com.", "a@b@c.de", "a@b.c@d.e", "a" * 300 + "@h.org", "é@x.yz", "1.2.3.4.5 256.1.1.1 1.2.3.0004",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567", "+1 23", "++49 30 123456789 1", "",
    ]
    rng = random.Random(1)
    texts += ["".join(rng.choice("a.@1 +-9(") for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t), t


def test_pii_adds_secrets_and_keeps_base(spark):
    rng = random.Random(5)
    texts = [None, "", "nothing here"]
    for i in range(60):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        texts.append(f'text token = "{key}" more 4{rng.randrange(10**14, 10**15)} and write to a{i}@mail.example.com now')
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in pii.find(docs, pii.fit(docs)).collect()}
    assert got[0].base == [] and got[1].spans == []
    for i, t in enumerate(texts[3:], 3):
        assert [(s.start, s.kind, s.end) for s in got[i].base] == [(a, pii.KINDS[k], b) for a, k, b in brute_base(t)]
        assert {(s.start, s.end) for s in got[i].base} <= {(s.start, s.end) for s in got[i].spans}
        a = t.index('"') + 1
        if all(b <= a or x >= a + 40 for x, _, b in brute_base(t)):  # a base span within the key stays alone
            assert ("secret", a, a + 40) in {(s.kind, s.start, s.end) for s in got[i].spans}


@pytest.mark.parametrize("text", ["JOHN(AT)EXAMPLE(DOT)COM", "jane at example[dot]org", "jane at example(dot)com", "Jane AT Example Dot org", "a[at]b dot c"])
def test_pii_spelled_addresses_are_candidates(text):
    assert pii.candidates(text, []) == [(0, 0, len(text))]


def test_pii_fit_reads_upper_case_addresses(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "reliabilities", lambda counts: seen.append(counts) or (_ for _ in ()).throw(StopAsyncIteration()))
    with pytest.raises(StopAsyncIteration):
        pii.fit(docs_of(spark, ["JOHN(AT)EXAMPLE(DOT)COM"]))
    assert [k for k, _ in seen[0]] == [0] and list(seen[0].values()) == [1]


def test_pii_time_grows_with_the_text():
    start = time.time()
    runs = ["7" * 1_000_000, "1." * 500_000, "a1B2" * 250_000, "x" * 1_000_000 + " at dot", "at-" * 300_000 + " dot", "a@" * 300_000, "555-123-4567 " * 50_000, "jane at x dot org " * 30_000]
    for text in runs:
        found = pii.candidates(text, pii.base_spans(text))
        for c in found[:100]:
            pii.votes_and_features(text, *c)
    assert time.time() - start < 60  # the first alone took hours when each digit was tried
    assert len(pii.candidates(runs[6], [])) == 50_000 and len(pii.candidates(runs[7], [])) == 30_000


def test_pii_precision_and_recall_of_added_spans(spark):
    rng = random.Random(8)
    words = "the of and river stone light paper window green often small table under about while road north".split()
    prose = lambda: " ".join(rng.choices(words, k=rng.randint(4, 25)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, of=letters: "".join(rng.choices(of, k=n - 1)) + str(rng.randrange(10))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    good = [
        lambda: ("password: ", key(16)), lambda: ("api_key=", key(32, "0123456789abcdef")), lambda: ("token ", "ghp_" + key(30)),
        lambda: ("secret = ", "AKIA" + key(16, letters[:26] + "0123456789")), lambda: ("call ", f"555-{digits(3)}-{digits(4)}"),
        lambda: ("phone: ", f"(212) {digits(3)}-{digits(4)}"), lambda: ("write to ", f"{rng.choice(words)}.{rng.choice(words)} at {rng.choice(words)} dot com"),
        lambda: ("contact ", f"{rng.choice(words)}(at){rng.choice(words)}(dot)org"),
    ]
    bad = [
        lambda: ("version ", f"release-notes-{digits(2)}"), lambda: ("see ", f"chapter_of_the_book_{digits(1)}"), lambda: ("order ", digits(14)),
        lambda: ("page ", f"{rng.choice(words)}-{rng.choice(words)}-{digits(4)}"), lambda: ("in ", f"2019.{digits(3)}.{digits(4)}"),
        lambda: ("we met at noon, ", f"the polka dot dress of {digits(4)}"),
    ]
    rows, planted = [], set()
    for i in range(1500):
        text = prose()
        for make, wanted in ((rng.choice(good), True), (rng.choice(bad), False)):
            if rng.random() < 0.7:
                before, span = make()
                start = len(text) + 1 + len(before)
                text = f"{text} {before}{span} {prose()}"
                if wanted:
                    planted.add((i, start, start + len(span)))
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    added = set()
    for r in pii.find(docs, pii.fit(docs)).collect():
        own = {(s.start, s.end) for s in r.base}
        added |= {(r.doc_id, s.start, s.end) for s in r.spans if (s.start, s.end) not in own}
    precision, recall = len(added & planted) / len(added), len(added & planted) / len(planted)
    print(f"added spans: precision {precision:.3f}, recall {recall:.3f} of {len(planted)}")
    assert precision > 0.9 and recall > 0.9


def test_pii_empty_table(spark):
    docs = docs_of(spark, ["a"]).limit(0)
    assert pii.find(docs, pii.fit(docs)).count() == 0


# --- language --------------------------------------------------------------------


def language_rows():
    rng = random.Random(8)
    parts = {"aa": ["ba", "bo", "ka", "lo"], "zz": ["shi", "tzu", "xen", "vyr"], "ru": ["да", "не", "то", "на"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    return make, [(i, make(k, 40), k) for i, k in enumerate(["aa", "zz", "ru"] * 20)]


def test_language_spans_and_defaults(spark):
    make, rows = language_rows()
    model = language.fit(spark.createDataFrame(rows + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string"))
    mixed = make("aa", 30) + " " + make("zz", 10)
    tests = [(0, None), (1, ""), (2, "123 !!"), (3, make("aa", 12)), (4, make("zz", 12)), (5, make("ru", 3)), (6, mixed), (7, mixed)]
    docs = spark.createDataFrame([(i, t, "other", 0.0) for i, t in tests], "doc_id long, text string, key string, score double")
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "aa", "zz", "ru"]
    assert got[0].score == 0 and got[0].spans == [] and 0 < got[6].score < 1
    assert [s.lang for s in got[6].spans] == ["aa", "zz"] and got[6].spans == got[7].spans
    assert mixed[got[6].spans[1].start : got[6].spans[1].end].strip() == mixed[got[6].spans[1].start :]


def test_language_without_training_rows(spark):
    _, rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}


def test_viterbi_against_table():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    first = np.array([0, 4, 4, 9, 10])
    score = rng.normal(size=(10, 3)) * 2
    got = language.viterbi(score, first, 1.5)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            value = lambda p: sum(score[a + i, k] for i, k in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
            best = max(itertools.product(range(3), repeat=b - a), key=value)
            assert tuple(got[a:b]) == best


# --- toxicity -----------------------------------------------------------------------


def test_automaton_against_distance():
    rng = random.Random(6)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9))): 1.0 for _ in range(40)}

    def near(a, b):  # one deletion, insertion, replacement or swap
        if a == b:
            return True
        options = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abcde"}
        options |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abcde"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return b in options

    scorer = toxicity.Scorer(toxicity.ToxicityModel(terms))
    for _ in range(1500):
        word = list(rng.choice(sorted(terms)))
        for _ in range(rng.randrange(3)):
            word[rng.randrange(len(word))] = rng.choice("abcde")
        word = "".join(word)
        want = any(near(word, t) for t in terms) if len(word) >= 5 else word in terms
        assert (scorer.weigh(word)[0] > 0) == want, word


def test_toxicity_learns_words_typos_and_quotes(spark):
    rng = random.Random(3)
    plain = [f"plain{a}" for a in "abcdefghij"]
    bad = ["grobak", "zumfelt", "wendrix"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        w = [rng.choice(plain) for _ in range(30)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    rows += [(1000, "plaina grobakk plainb zumfetl plainc wendri plaind", "x"), (1001, None, "x"), (1002, "", "x"), (1003, "plaina " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marked = spark.createDataFrame(labels + [(299, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marked)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)
    assert got[1000] >= 0.5 and got[1001] < 0.5 and got[1002] == got[1001] and got[1003] < 0.5
    scorer = toxicity.Scorer(model)
    (plain_hit,), (quoted_hit,) = scorer.hits("plaina grobak plainb")[0], scorer.hits('plaina said "grobak" plainb')[0]
    assert quoted_hit[4] < plain_hit[4]


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}


# --- pages -----------------------------------------------------------------------------

PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a><a href=y>News</a></nav>{body}<footer>All rights</footer></body></html>"


def test_pages(spark):
    article = "<article class=post><h1>Title &amp; more</h1><p>One <b>two</b>\n three<br>four<p>Five<aside>ad</aside><div class='comments'><p>me too</p></div><form>q</form></article>"
    plain = lambda k: f"<div><p>Welcome to the site</p></div><div><p>Story {k} begins.</p><p>And ends {k}.</p></div><p>Call us</p>"
    rows = [
        (1, "http://a.com/x/1", PAGE.replace("{body}", article)),
        (2, "http://a.com/x/2", PAGE.replace("{body}", article)),  # a copy: the article stays
        (3, "http://b.com/1", PAGE.replace("{body}", plain(1))),
        (4, "http://b.com/2", PAGE.replace("{body}", plain(2))),
        (5, None, None),
        (6, "http://c.com/", ""),
        (7, "http://d.com/", PAGE.replace("{body}", "<main><p>Alone</p><script>var a='<p>no</p>';</script></main>")),
        (8, "nonsense", "<p>open <i>only"),
    ]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, lines int").repartition(1)
    got = {r.page_id: r for r in html.extract(pages).collect()}
    want = "Title & more\nOne two three four\nFive"
    assert got[1].text == got[2].text == want and got[1].n_chars == len(want)
    assert got[3].text == "Story 1 begins.\nAnd ends 1." and got[4].text == "Story 2 begins.\nAnd ends 2."
    assert got[5].text == "" and got[6].text == "" and got[7].text == "Alone" and got[8].text == "open only"
    assert got[5].n_chars == 0 and got[5].url is None


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><p>Text</p></body>",
        "<body class='cookie'><main class='search'><p>Text</p></main></body>",
        "<div id='page' class='with-navbar'><p>Text</p><div class='ad'>buy</div></div>",
        "<article class='related-news search'><p>Text</p><div class='x share'>send</div></article>",
        "<form><div class='sidebar'>menu<article><p>Text</p></article></div></form>",
        "<article><p>Text</p><section class='comments'><article><p>me too</p></article></section></article><aside><article>more</article></aside>",
        "<main hidden><p>gone</p></main><p>Text</p>",
    ],
)
def test_names_do_not_empty_a_page(page):
    assert html.main_text(*html.page_lines(page), set()) == "Text"


def test_lines_that_articles_share_go(spark):
    story = lambda k: f"<article><p>Story {k} {'abc' * (k + 3)}</p><p>More of {k} {'xyz' * (k + 3)}</p><p>Subscribe here</p></article>"
    rows = [(k, f"http://a.com/{k}", PAGE.replace("{body}", story(k))) for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {k: f"Story {k} {'abc' * (k + 3)}\nMore of {k} {'xyz' * (k + 3)}" for k in range(4)}


def test_witness_beyond_copies_and_near_copies(spark):
    body = lambda k, n: f"<div><p>Welcome to the site</p></div><p>Story {k} {'abc' * (k + 9)}</p><p>And it ends {k}.</p><p>Seen {n} times</p>"
    rows = [(k, f"http://a.com/{k}", PAGE.replace("{body}", body(*b))) for k, b in enumerate([(0, 0), (1, 1), (1, 1), (1, 1), (1, 2), (1, 3), (2, 4)])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    text = lambda k, n: f"Story {k} {'abc' * (k + 9)}\nAnd it ends {k}.\nSeen {n} times"
    assert got == {k: text(*b) for k, b in enumerate([(0, 0), (1, 1), (1, 1), (1, 1), (1, 2), (1, 3), (2, 4)])}


def test_pages_are_extracted_alike_in_any_number_of_partitions(spark):
    """Runs of copies and template lines across the borders of blocks; articles keep a sentence that two of them share."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    rows, want = [], {}
    for host in range(4):
        story, k = None, 0
        while k < (40 if host else 3):
            story = [line(9) for _ in range(6)]
            for _ in range(rng.choice([1, 1, 1, 7, 15])):  # copies beside each other
                body = "<p>Welcome here</p>" + "".join(f"<p>{x}</p>" for x in story) + f"<p>Call host {host}</p>"
                rows.append((len(rows), f"http://h{host}.com/p/{k:03d}", PAGE.replace("{body}", body)))
                want[len(rows) - 1] = "\n".join(story)
                k += 1
    for k in range(30):  # articles of one host: the invitation goes, a sentence of two of them stays
        story = [line(9) for _ in range(5)] + (["Les."] if k in (4, 5) else [])
        body = "<article>" + "".join(f"<p>{x}</p>" for x in story) + "<p>Subscribe now</p></article>"
        rows.append((len(rows), f"http://art.com/{k:02d}", PAGE.replace("{body}", body)))
        want[len(rows) - 1] = "\n".join(story)
    rows += [(len(rows) + i, u, "<p>alone</p>") for i, u in enumerate([None, "", "mailto:x", None, "http://one.com"])]
    want |= {r[0]: "alone" for r in rows[-5:]}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.page_id: r.text for r in html.extract(pages).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert html.extract(pages.limit(0)).collect() == []


def test_page_query(spark):
    got = html.op9_html_extraction(spark, "/root/testdata/sf0.001")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = got.collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:  # all of these pages have an article
        assert r.text == html.main_text(*html.page_lines(pages[r.page_id].html), set()) and r.n_chars == len(r.text)


def test_markup_is_read_once_forward():
    start = time.time()
    for bad in ("<a " * 300_000, '<a "' * 200_000, "<p x='" * 200_000, "<!--" * 200_000, "<![CDATA[" * 100_000, "<" * 500_000, "<script>" * 50_000, "<div>" * 50_000 + "</p>" * 100_000):
        html.page_lines(f"<p>before</p>{bad}")
    assert time.time() - start < 60  # each took minutes when every tag looked for its end on its own
    assert html.page_lines("<p>a < b <i x='>'>c</i> <b y=\"never closed>d</b><!-- x --><p>e<!-->f<svg/>g<title>no</title>h</p><a ")[0] == ["a < b c d", "efgh", "<a"]


def test_common_subsequence_of_many_lines():
    rng = random.Random(2)
    a = [str(rng.randrange(3000)) for _ in range(6000)]
    b = [str(rng.randrange(3000)) for _ in range(6000)]
    found = sorted(html.aligned(a, b))
    it = iter(b)
    assert all(a[i] in it for i in found)
    assert len(found) == int(html.lengths(a, b)[-1]) > 100  # halves give as long a sequence as one pass


def test_common_subsequence_against_table(monkeypatch):
    monkeypatch.setattr(html, "SMALL", 8)
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(12))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        taken = [a[i] for i in sorted(html.aligned(a, b))]
        it = iter(b)
        assert len(taken) == row[-1] and all(x in it for x in taken)


# --- shared pieces ------------------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, 1000 + k) for k in range(200)] + [(2000 + k, 2001 + k) for k in range(100)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    store = common.Store(spark, "test")
    got = {r.id: r.component for r in common.components(store, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root}


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    texts = ["The the THE", None, "", "a b a b", "É é e\tE\x0be\r\n"]
    hashes, row, first = common.doc_words(pa.array(texts, pa.string()))
    spoken = [w for t in texts for w in words(t)]
    assert len(hashes) == len(spoken) and list(first) == [0, 3, 3, 3, 5, 10][: len(first)]
    assert len(set(hashes.tolist())) == len(set(spoken))
    by = dict(zip(hashes.tolist(), spoken))
    assert [by[h] for h in hashes.tolist()] == spoken and Counter(row.tolist())[0] == 3


# --- learned operators: what they may learn from -----------------------------------------------


def changed_copy(spark, folder, **tables):
    """The smallest test folder with some tables replaced."""
    base = "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{base}/{name}.parquet")
        tables.get(name, lambda x: x)(df).write.parquet(f"{folder}/{name}.parquet")
    return folder


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def test_toxicity_query_learns_nothing_from_held_out_rows(spark, tmp_path):
    plain = toxicity.op8_toxicity(spark, "/root/testdata/sf0.001")
    assert plain.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = plain.collect()
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(HELD_OUT).collect()}
    assert {r.doc_id for r in rows if r.held_out} == held
    flipped = changed_copy(spark, str(tmp_path), labels=lambda x: x.withColumn("toxic", F.when(F.expr(HELD_OUT), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    again = toxicity.op8_toxicity(spark, flipped).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in rows}


def test_toxicity_query_with_empty_tables(spark, tmp_path):
    folder = changed_copy(spark, str(tmp_path), documents=lambda x: x.limit(0), labels=lambda x: x.limit(0))
    assert toxicity.op8_toxicity(spark, folder).collect() == []


def test_language_query_learns_nothing_from_held_out_rows(spark, tmp_path):
    plain = language.op3_language_id(spark, "/root/testdata/sf0.001")
    assert plain.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = plain.collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = {r.lang for r in docs.where(f"not ({HELD_OUT})").select("lang").distinct().collect()} - {None}
    assert len(rows) == docs.count() and {r.lang_pred for r in rows} <= learned | {"und"} and all(0 <= r.score <= 1 for r in rows)
    other = changed_copy(spark, str(tmp_path), documents=lambda x: x.withColumn("lang", F.when(F.expr(HELD_OUT), "xx").otherwise(F.col("lang"))))
    again = language.op3_language_id(spark, other).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in again} == {(r.doc_id, r.lang_pred, r.score) for r in rows}
