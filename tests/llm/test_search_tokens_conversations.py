"""Top-k search, token alignment and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickflow.llm import conversations as CV
from clickflow.llm import token_alignment as TA
from clickflow.llm import topk_search as TK
from clickflow.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"


# --- top-k search ---------------------------------------------------------------


def usable(v):
    return v is not None and None not in v and np.isfinite(v).all()


def best_rows(rows, k):
    fine = [(i, v) for i, v in rows if i is not None and usable(v)]
    whole = {id(v): [int(np.floor(256 * x)) for x in v] for _, v in fine}
    out = []
    for i in sorted({i for i, _ in fine if i % 50 == 0}):
        query = whole[id(min((v for j, v in fine if j == i)))]
        scored = sorted((-sum(a * b for a, b in zip(query, whole[id(v)])), j) for j, v in fine if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return out


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # copies: ties
    rows += [(0, rows[0][1]), (3, rows[3][1]), (None, [1.0] * 8)]  # repeated rows, no id
    rows += [(2000, None), (2001, [None] * 8), (2050, [float("nan")] * 8), (2002, [float("inf")] * 8), (2003, []), (2100, []), (2004, [1.0, 2.0]), (2150, [3.0]), (2005, [1e5] * 8), (2200, [0.0] * 8)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, g int")
    queries = table.where("vec_id % 50 = 0")
    expected = best_rows(rows, 5)
    for options in ({}, {"part": 16, "group": 3}, {"sliced": 1}, {"sliced": 60}):
        assert sorted(map(tuple, TK.top_k(table, queries, **options).collect())) == expected
    few = table.where("vec_id < 3")
    assert sorted(map(tuple, TK.top_k(few, few.where("vec_id = 0")).collect())) == best_rows(rows[:3], 5)
    assert TK.top_k(table.limit(0), queries).collect() == TK.top_k(table, queries.limit(0)).collect() == []
    huge = spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        TK.top_k(huge, huge).collect()


def test_bitmap_sums_and_selection():
    rng = np.random.default_rng(1)
    values, query = rng.integers(-40, 90, (200, 5)), rng.integers(-60, 60, 5)
    index = TK.Block(np.arange(200), values, sliced=60)
    slices = index.sums(query)
    got = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(int) << i for i, s in enumerate(slices)), np.zeros(200, int))
    assert len(set((got - values @ query).tolist())) == 1  # equal but for a constant
    assert TK.kth_largest(slices, index.rows, 7) == sorted(got)[-7]
    assert TK.positions(TK.at_least(slices, index.rows, int(sorted(got)[-7]))).tolist() == np.flatnonzero(got >= sorted(got)[-7]).tolist()


def test_topk_query(spark):
    got = TK.op11_topk_search(spark, SF)
    assert [f.simpleString() for f in got.schema] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:bigint"]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE["op11_topk_search"]).fetchall())


# --- token alignment ---------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(f"{TA.FOLDER}/{TA.FILE_A}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{TA.FOLDER}/{TA.FILE_B}")
    letters = TA.byte_letters()
    bytes_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if all(c in letters for c in t)}
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    return a, b, bytes_a, bytes_b


def token_groups(text, tokenizers):
    a, b, bytes_a, bytes_b = tokenizers
    if not text:
        return []
    whole = (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [bytes_a[i] for i in ids[0]], [bytes_b[i] for i in ids[1]]
    if any(b"".join(p) != whole for p in parts):
        return []
    ends = [list(itertools.accumulate(map(len, p))) for p in parts]
    out, at = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        to = [e.index(cut, i) + 1 for e, i in zip(ends, at)]
        out.append(tuple(x[i:j] for x, i, j in zip(ids, at, to)))
        at = to
    return out


def expected_alignment(rows, tokenizers):
    groups = [token_groups(text, tokenizers) for _, text in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = Counter(p for doc in links for p in set(doc))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (key, _), g, doc in zip(rows, groups, links):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        digest = hashlib.sha256(written.encode()).hexdigest() if g else ""
        best = sum(count[p] == most[p[0]] for p in doc)
        out.append((key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(doc), best, sum(count[p] for p in doc), digest))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "\n"), (6, "  two  spaces \n\n  x"), (7, "<|endoftext|> <s> </s> hi"), (8, "a" * 5000),
    (None, "x y z　 q \xa0 r\x85 s"), (9, "日本語 テスト 😀 é́"), (10, "\x00 \x1f b"), (11, "don't I'll  \t tab"), (12, "▁ a ▁b"),
    (1, "again"), (13, "again again. Again"), (14, "ab " * 30_000), (15, " \n \n" * 200),
]


def test_alignment_of_odd_texts(spark, tokenizers):
    rng = random.Random(2)
    letters = "ab1'\n\t .sdré　\xa0漢😀"
    rows = ODD + [(100 + i, "".join(rng.choices(letters, k=rng.randint(1, 60)))) for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, uid int, key string")
    for cell in (TA.CELL, 50):
        assert sorted(map(tuple, TA.align(df, cell=cell).collect()), key=str) == expected_alignment(rows, tokenizers)
    assert TA.align(df.limit(0)).collect() == []


def test_alignment_query(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = TA.op12_token_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected_alignment(rows, tokenizers)


def test_groups_of_texts(spark, tokenizers):
    rows = [(i, t) for i, t in ODD if i and i < 13 and i != 1]
    got = defaultdict(list)
    for r in TA.token_groups(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "start").collect():
        got[r.doc_id].append((r.a, r.b))
        assert r.end > r.start == (0 if len(got[r.doc_id]) == 1 else last)
        last = r.end
    assert got == {i: g for i, t in rows if (g := token_groups(t, tokenizers))}


def test_every_entry_of_the_vocabulary_has_the_ids_of_its_file(tokenizers):
    """The merge ranks in use give what the tokenizer file gives, for each entry of it as a text."""
    a, _, bytes_a, _ = tokenizers
    tokens = TA.loaded(TA.FOLDER, TA.FILE_A, TA.FILE_B).tokens
    texts = [" " + t.decode("utf-8", "ignore") for t in bytes_a.values()]
    for text, e in zip(texts, a.encode_batch(texts, add_special_tokens=False)):
        assert tokens.a.encode_ordinary(text) == e.ids


def test_large_groups_are_linked_in_pieces(monkeypatch):
    tokens = TA.loaded(TA.FOLDER, TA.FILE_A, TA.FILE_B).tokens
    text = b" " + "".join(random.Random(1).choices("日本漢字テスト", k=300)).encode() + b" abc abc"
    groups = TA.Groups(tokens, *tokens.encode([text, text]))
    whole = [x.tolist() for x in groups.pairs()]
    monkeypatch.setattr(TA, "EXPANDED", 3)
    assert [x.tolist() for x in groups.pairs()] == whole
    assert sum(whole[2]) == int((groups.n_a * groups.n_b).sum())


# --- conversation repair ---------------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        yield from [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)


def cheapest_repair(rows, faults):
    """All states row by row with whole audits and rows."""

    def with_inserts(best):
        again = True
        while again:
            again = False
            for s, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    j, new = NEXT.get((s, role[0])), (cost + 5, audit + "I", out + ((role, ""),))
                    if j is not None and (j not in best or new[:2] < best[j][:2]):
                        best[j], again = new, True
        return best

    best = {0: (0, "", ())}
    for (role, text), fault in zip(rows, faults):
        found = {}

        def put(j, new):
            if j not in found or new[:2] < found[j][:2]:
                found[j] = new

        for s, (cost, audit, out) in with_inserts(best).items():
            put(s, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            stay = cost + 5 * (fault == "truncated")
            if (s, role[:1]) in NEXT:
                put(NEXT[s, role[:1]], (stay, audit + "K", out + ((role, text),)))
            for other in ("user", "assistant"):
                if (s, other[0]) in NEXT:
                    put(NEXT[s, other[0]], (stay + 1, audit + "R", out + ((other, text),)))
        best = found
    best = with_inserts(best)
    return min((best[j] for j in (0, 3) if j in best), key=lambda x: x[:2])


def expected_repairs(rows):
    groups = {c: [] for c, *_ in rows}
    for c, *r in damage(rows):
        groups[c].append(r)
    out = []
    for c, rs in groups.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, r, x in rs:
            end = x.rstrip(SPACES)[-1:]
            faults.append("blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, *_ in rs if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit, kept = cheapest_repair([r[1:] for r in rs], faults)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out.append((c, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def made_up(n=60):
    rng, rows = random.Random(5), []
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["a.", "b", "", None, " ", "hello!  \n", "q?", "é 漢。", "x.\x0b"]
    for c in [None, *range(n)]:
        for i in range(400 if c == 7 else rng.choice([1, 2, 5, 30])):
            rows.append((c, rng.choice([None, i, i, rng.randint(0, 9)]), rng.choice(roles), rng.choice([*texts, f"{i}."])))
    return rows + [(n, 3, "user", "one. " * 50_000), (n, 4, "assistant", "same."), (n, 5, "assistant", "same.")]


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_repair_query_against_brute_force(spark, tmp_path, partitions):
    rows = made_up()
    folder = str(tmp_path)
    extra = spark.createDataFrame(rows, CONV).withColumns({"c": F.lit(1), "kind": F.lit("x"), "digest": F.lit(2)})
    extra.write.parquet(f"{folder}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = CV.op13_conversation_repair(spark, folder)
        assert sorted(map(tuple, got.collect()), key=str) == expected_repairs(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"create table conversations as select conv_id, turn, role, text from '{SF}/conversations.parquet'")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [(None if c is None else c + 10_000, *r) for c, *r in made_up(20)])
    rows = con.execute("select * from conversations").fetchall()
    assert sorted(con.execute(ORACLE["op13_conversation_repair"]).fetchall(), key=str) == expected_repairs(rows)


def test_repaired_rows_and_empty_tables(spark):
    rows = [(1, 0, "assistant", "hi."), (1, 1, "user", "cut off"), (1, 2, "user", "well?"), (2, 0, "system", "s."), (2, 1, "user", "u.")]
    df = spark.createDataFrame(rows, CONV)
    repairs = CV.repair(df)
    assert {r.c: (r.cost, r.audit) for r in repairs.collect()} == {"=1": min_repair(rows, 1), "=2": min_repair(rows, 2)}
    got = defaultdict(list)
    for r in CV.repaired_rows(df, repairs).orderBy("c", "place").collect():
        got[r.c].append((r.role, r.text))
    for c in (1, 2):
        kept = cheapest_repair([(r, x) for k, _, r, x in rows if k == c], faults_of(rows, c))[2]
        assert got[f"={c}"] == list(kept)
    empty = df.limit(0)
    assert CV.repair(empty).collect() == CV.repaired_digests(empty, CV.repair(empty)).collect() == []


def faults_of(rows, c):
    return ["" if x[-1] in ".!?" else "truncated" for k, _, _, x in rows if k == c]


def min_repair(rows, c):
    return cheapest_repair([(r, x) for k, _, r, x in rows if k == c], faults_of(rows, c))[:2]


def test_grammar_gives_what_row_by_row_matrices_give():
    rng = random.Random(9)
    sequences = [bytes(rng.choices(range(9), k=rng.randint(1, 300))) for _ in range(20)] + [bytes([2]) * 257, bytes([2, 4]) * 100]
    grammar = CV.Grammar()
    for s, vector in zip(sequences, grammar.vectors(sequences)):
        plain = CV.START
        for symbol in s:
            plain = CV.times(plain, CV.one_row(symbol))
        assert CV.cheapest(vector) == CV.cheapest(plain) == CV.cheapest(grammar.matrix(s)[0])
    for symbols, s in zip(grammar.compress(sequences), sequences):
        rules = {v: k for k, v in grammar.rules.items()}
        expand = lambda x: expand(rules[x][0]) + expand(rules[x][1]) if x in rules else [x]
        assert sum(map(expand, symbols), []) == list(s)
    again = len(grammar.rules)
    grammar.vectors(sequences)
    assert len(grammar.rules) == again  # shared with earlier conversations


def test_ropes_compare_like_strings():
    rng = random.Random(4)

    def rope(s):
        if len(s) < 2 or rng.random() < 0.2:
            return CV.Rope(s)
        k = rng.randint(0, len(s))
        return rope(s[:k]) + rope(s[k:])

    for _ in range(500):
        x, y = ("".join(rng.choices("DK", k=rng.randint(0, 12))) for _ in range(2))
        assert (rope(x) < rope(y)) == (x < y) and str(rope(x)) == x
