"""The pipeline against a brute-force version of its stages."""

import hashlib
import re
from collections import defaultdict

import tiktoken

import corpus_pipeline
from lodestack.llm import byte_bpe, decontaminate, language_id
from lodestack.llm._spark import table

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(docs)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for (i, t), bad in zip(rows.items(), model.predict([t or "" for t in rows.values()])[2]) if not bad}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    rows = {i: rows[i] for i in last.values()}
    sets, links = {}, defaultdict(set)
    for i, t in rows.items():
        w = tuple(re.findall(r"\w+", t.lower()))
        sets[i] = (w, {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set())
    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a][1] & sets[b][1])
            if sets[a][0] == sets[b][0] or both and both >= 0.8 * len(sets[a][1] | sets[b][1]):
                links[a].add(b)
                links[b].add(a)
    seen, kept = set(), []
    for i in ids:
        if i not in seen:
            kept.append(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += links[x]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    held = {m[0] for m in decontaminate.matches(decontaminate.build(items), [rows[i] for i in kept])}
    kept = [i for k, i in enumerate(kept) if k not in held]
    bpe = byte_bpe.public_bpe()
    library = tiktoken.Encoding("own", pat_str=bpe.pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    want = set()
    for i in kept:
        got = library.encode_ordinary(rows[i])
        want.add((i, len(got), hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(rows[i].encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "same text here", "en", "s", 1), (1, "same text here", "en", "s", 1), (2, "same text here", "en", "s", 1), (3, "x " * 50000, "fr", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        counts[name] = stage(spark, docs, SF).count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert counts["exact_dedup"] == 3 and counts["byte_bpe"] == 6 and counts["decontamination"] == 6
