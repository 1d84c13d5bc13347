import hashlib
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

cp = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {"input": spark.read.parquet(f"{SF}/documents.parquet")}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return {k: v.collect() for k, v in out.items()}


def test_columns_and_toxicity(stages):
    names = list(stages["input"][0].asDict())
    for stage in list(stages)[:-1]:
        assert list(stages[stage][0].asDict()) == names
    kept = {r.doc_id for r in stages["toxicity"]}
    assert {r for r in stages["toxicity"]} <= set(stages["input"]) and 0.8 < len(kept) / len(stages["input"]) <= 1


def test_lines(stages):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for r in stages["toxicity"]:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if len(h := holders.get(key(x), ())) < 3 or r.doc_id == max(h)) for r in stages["toxicity"]}
    assert {r.doc_id: r.text for r in stages["line_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"])


def test_near_copies(stages):
    def shingles(t):
        w = ("".join(c.lower() if "A" <= c <= "Z" else c for c in t)).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    rows = sorted((r.doc_id, shingles(r.text)) for r in stages["line_dedup"])
    comp = {d: d for d, _ in rows}
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r.doc_id for r in stages["near_dedup"]} == {d for d, c in comp.items() if d == c}


def test_decontamination(stages, spark):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages["near_dedup"] if not any(s and 100 * len(s & shingles(r.text)) >= 80 * len(s) for s in items)}
    assert {r.doc_id for r in stages["decontamination"]} == want and len(want) < len(stages["near_dedup"])


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in stages["packing"]:
        pieces[r.doc_id].append((r.start, r.ids))
    assert len(pieces) == len(stages["decontamination"])
    for r in stages["decontamination"]:
        ids = np.frombuffer(b"".join(i for _, i in sorted(pieces[r.doc_id])), "<u4").tolist()
        assert ids == [*t.encode(r.text or "", add_special_tokens=False).ids, 1]


def whole(rows):
    """Each document's ids, put together from its pieces."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    return {d: hashlib.sha256(b"".join(i for _, i in sorted(p))).hexdigest() for d, p in pieces.items()}


def test_run_gives_the_same(stages, spark):
    assert whole(cp.run(spark, SF).collect()) == whole(stages["packing"])


def test_run_over_odd_tables(spark, tmp_path):
    """No rows; then null texts, ids and languages, empty texts and repeated rows. The caller's session keeps its settings."""
    docs, labels, items = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int", "item_id long, text string"
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}

    def tables(name, rows):
        for table, data, schema in (("documents", rows, docs), ("labels", [], labels), ("benchmark", [], items)):
            spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / f"{table}.parquet"))
        return str(tmp_path / name)

    assert cp.run(spark, tables("none", [])).count() == 0
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "one two three four five six", "en", None, 27), (3, "one two three four five six", "en", None, 27), (4, "one two three four five six", None, "s", 27)]
    got = cp.run(spark, tables("odd", rows)).collect()
    # 4 is a copy of 3; rows that share an id stay together.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 3), (True, 0)]
    assert {k: spark.conf.get(k) for k in before} == before
