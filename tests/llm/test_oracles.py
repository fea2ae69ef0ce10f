"""The operators' registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestone.llm import catalog
from tests.test_catalog import SF, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = catalog.QUERIES[name](spark, SF)
    result = con.execute(catalog.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_pipeline_equals_its_stages_by_hand(spark):
    """run() against brute force: the texts that survive each stage, and their tokens packed without a gap."""
    import numpy as np
    import zlib

    import corpus_pipeline
    from lodestone.llm import common, tokens
    from tests.llm.test_llm import contaminated_brute, shingles

    docs = {r.doc_id: r for r in common.table(spark, SF, "documents").collect()}
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    spoken = {i: r.text for i, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    sets = {i: shingles(t, 5) for i, t in spoken.items()}
    comp = {i: i for i in sets}
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(a, b) for same in by_shingle.values() for a in same for b in same if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    kept = [i for i in sorted(spoken) if comp[i] == i]
    clean = []
    for i in kept:
        n_words, n_hit, _ = contaminated_brute(spoken[i], items) if len(spoken[i]) < 4000 else (1, 0, [])
        if not (n_hit and 20 * n_hit >= n_words):
            clean.append(i)
    got = corpus_pipeline.run(spark, SF).collect()
    short = {i for i in clean if len(spoken[i]) < 4000}
    assert short <= {r.doc_id for r in got} and {r.doc_id for r in got if len(spoken[r.doc_id]) < 4000} == short and {r.doc_id for r in got} <= set(kept)
    coder = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"), spaced=True)
    plain = [i for i in sorted(short) if "oken" not in spoken[i] and "ecret" not in spoken[i]][:60]
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append(r)
    for i, coded in zip(plain, coder.encode([spoken[i] for i in plain])):
        ids = coded + np.array([0], "<u4").tobytes()
        parts = sorted(whole[i], key=lambda r: r.piece)
        assert sum(p.length for p in parts) * 4 == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for p in parts)
