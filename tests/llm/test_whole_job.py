"""Operators do the whole job whatever their bounds of memory: results do not depend on them."""

from __future__ import annotations

from tabassay.llm import language_id


def test_language_of_long_texts_is_not_learned_from_one_short_text(spark):
    rows = [(0, "ok", "a"), (1, "the cat sat on the mat and ran away " * 200, "a"), (2, "der Hund lief durch den Wald nach Haus " * 50, "b")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.texts == [f"ok\n{rows[1][1]}".encode(), rows[2][1].encode()]
