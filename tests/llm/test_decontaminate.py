import re

import duckdb

from cases import MESSY, documents, empty
from kinrank.llm import decontaminate as D
from kinrank.llm.queries import _DECONTAMINATION_SQL
from pyspark.sql import functions as F

P = " ".join(f"alpha{i} beta gamma" for i in range(6))
ITEMS = [(1, P), (2, "One TWO three"), (3, ""), (4, None), (10, P + " tail end"), (None, "alpha0 beta gamma"), (2, "One TWO three"),
         (11, "ß é"), (12, "x x x x x x x x x x x")]
TEXTS = [*MESSY, "intro " + P + " outro", P.upper().replace(" ", ", "), "one-two...three ONE two", "alpha0 beta gam ma",
         "x " * 30, "é ß é", " ".join(P.split()[3:14])]


def brute(texts, items):
    def w(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    windows = {(i, tuple(x[k:k + 10])) for i, t in items for x in [w(t)] if x for k in range(max(len(x) - 10, 0) + 1)}
    out = []
    for t in texts:
        x, hit, who = w(t), set(), set()
        for i, g in windows:
            for k in range(len(x) - len(g) + 1):
                if tuple(x[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    who |= {str(i)} - {"None"}
        out.append((len(x), len(hit), sorted(who)))
    return out


def test_matches_brute_force_in_one_and_in_many_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(*i, "extra") for i in ITEMS], "item_id bigint, text string, window string")
    docs = documents(spark, TEXTS)
    want = brute(TEXTS, ITEMS)
    for block in (D.BLOCK, 8):
        monkeypatch.setattr(D, "BLOCK", block)
        rows = D.contamination(docs, bench).select("doc_id", "n_words", D.n_hit().alias("n"), "items").collect()
        assert len(rows) == docs.count()
        assert {r.doc_id: (r.n_words, r.n, list(r["items"])) for r in rows if r.doc_id is not None} == dict(enumerate(want))
        kept = D.without_contaminated(docs, bench)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} - {None} == {i for i, x in enumerate(want) if not x[1]}
        left = {r.doc_id: r.text for r in D.without_spans(docs, bench).collect() if r.doc_id is not None}
        assert left[len(MESSY)] == "intro  outro" and left[0] == " four" and left[2] is None
        assert sum(x[1] for x in brute(left.values(), [i for i in ITEMS if i[0] == 10])) == 0
    assert D.contamination(empty(spark), bench).count() == 0
    assert {r.n_words for r in D.contamination(docs, bench.where("false")).collect()} == {x[0] for x in want}


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [i for i in ITEMS if i[0] is not None])
    want = brute(TEXTS, [i for i in ITEMS if i[0] is not None])
    got = con.execute(f"SELECT doc_id, n_words, n_hit, n_items FROM ({_DECONTAMINATION_SQL}) ORDER BY 1").fetchall()
    assert got == [(i, n, h, len(w)) for i, (n, h, w) in enumerate(want)]
