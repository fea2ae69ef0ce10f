"""Bars for what the two classifiers tell of held-out documents."""

import os

import pytest

from lodestone.llm import catalog, common

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_languages_of_held_out_documents(spark):
    lang = common.table(spark, SF, "documents").select("doc_id", "lang").where("lang IS NOT NULL")
    rows = catalog.QUERIES["op8_language_id"](spark, SF).where("held_out").join(lang, "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


def test_toxic_held_out_documents(spark):
    """The English ones, of which the labelled sample of so small a table has enough; clean ones of all languages."""
    told = common.table(spark, SF, "documents").select("doc_id", "lang").join(common.table(spark, SF, "labels").select("doc_id", "toxic"), "doc_id")
    rows = catalog.QUERIES["op4_toxicity"](spark, SF).where("held_out").join(told, "doc_id").select("lang", "toxic", "predicted").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1 and r.lang == "en"]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert len(toxic) >= 5 and sum(toxic) >= 0.9 * len(toxic)
    assert len(clean) > 50 and sum(clean) <= 0.02 * len(clean)
