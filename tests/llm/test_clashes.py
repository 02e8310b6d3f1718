"""Stages keep every column of their input, whatever its name."""

import pytest

from sparsewell.llm import decontam, langid, mixing, ngramjoin

NAMES = ["_id", "_key", "_own", "_place", "_copy", "_copies", "key", "of", "of_key", "of_place", "place", "copies", "row", "col", "component", "best", "size", "sid", "n", "a.b", "x`y"]
STAGES = {
    "language": lambda d: langid.identified_documents(d, langid.learn(d)),
    "join": ngramjoin.representatives,
    "decontam": lambda d: decontam.clean_documents(d, d.sparkSession.createDataFrame([(1, "benchmark words that stand here")], "item_id long, text string")),
    "mix": mixing.mixed_documents,
}
TEXTS = ["the quick brown fox jumps over the lazy dog near the river bank", "le renard brun saute par dessus le chien paresseux", "some benchmark words that stand here", None, "the quick brown fox jumps over the lazy dog near the river bank"]


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_values_of_clashing_columns(spark, stage):
    rows = [(i, t, "fr" if t and "renard" in t else "en", "s", *(f"{c}-{i}" for c in NAMES)) for i, t in enumerate(TEXTS)]
    quoted = ", ".join("`" + c.replace("`", "``") + "` string" for c in NAMES)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {quoted}")
    out = STAGES[stage](docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and {tuple(r) for r in got} <= set(rows)
