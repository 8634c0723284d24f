import ast
import hashlib
import os

import corpus_pipeline as C
from kinrank.llm import decontaminate, line_dedup, simhash, toxicity
from kinrank.llm.bpe import Bpe
from kinrank.llm.queries import QUERIES, _tokenizer
from kinrank.llm.shared import held_out, table

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    model = toxicity.fit(docs, toxicity.sample(table(spark, SF, "labels", "doc_id", "toxic"), "toxic", held_out(3)))
    judge = toxicity._judge(model)
    left = {i: r for i, r in rows.items() if judge(r["text"])[0] < C.TOXIC}

    sites = {}
    for r in left.values():
        for line in r["text"].split("\n"):
            sites.setdefault(line.strip(line_dedup.BLANK), set()).add(r["source"])
    common = {x for x, s in sites.items() if x and len(s) >= line_dedup.MIN_SITES}
    for r in left.values():
        lines = r["text"].split("\n")
        kept = [x for x in lines if x.strip(line_dedup.BLANK) not in common]
        if len(kept) < len(lines) and "".join(kept).strip():
            r["text"] = "\n".join(kept)
            r["n_chars"] = len(r["text"])

    fps = {i: simhash.fingerprint(r["text"]) for i, r in left.items()}
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            low = min(group[j] for j in fps if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3)
            if low < group[i]:
                group[i], changed = low, True
    left = {i: r for i, r in left.items() if group[i] == i}

    block = decontaminate._Block([(str(r.item_id), " ".join(w)) for r in table(spark, SF, "benchmark").collect()
                                  for x in [[b.decode() for b in decontaminate.words(r.text)]] if x
                                  for k in range(max(len(x) - 10, 0) + 1) for w in [x[k:k + 10]]])
    left = {i: r for i, r in left.items() if not block.find(decontaminate.words(r["text"]))[0]}
    bpe = Bpe(_tokenizer("word_bpe_49k.json"))
    want = {}
    for i, r in left.items():
        ids, text = bpe.encode(r["text"])
        want[i] = (len(ids) // 4, hashlib.sha256(text.encode()).hexdigest())

    got = C.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in C.STAGES][2] == "simhash_near_dedup" and len(C.STAGES) == 5
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert C.encode(spark, docs.where("false"), SF).count() == 0


def test_all_queries_are_registered():
    import __spark_entry__ as e
    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(C.__file__))
    for folder, _, files in os.walk(os.path.join(root, "kinrank")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, f), encoding="utf-8").read())
                names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
                names += [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                assert not any("llm" in n.split(".") for n in names), f
