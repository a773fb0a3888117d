from __future__ import annotations

import pytest

from caseflow.functions.texts import filled, quoted


@pytest.mark.parametrize("text", ["plain", "it's", 'say "x"', "back\\slash", "it\\'s", "äöü", "a\nb", ""])
def test_quoted(spark, text):
    assert spark.sql(f"SELECT {quoted(text)}").first()[0] == text


def test_filled(spark):
    assert spark.sql("SELECT " + filled("'{a}' is {b}.", a="1 + 1", b="'x'")).first()[0] == "'2' is x."
