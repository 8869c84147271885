"""Columns to carry along: a clash of names is refused, any other name is kept."""

import pytest

from conflictlake.llm import mixing, quality, url_cascade, wrappers

CASES = [
    (lambda df, keep: quality.judge(df, keep=keep), "code"),
    (lambda df, keep: quality.judge(df, keep=keep), "KEPT"),
    (lambda df, keep: mixing.mix(df, [1], keep=keep), "size"),
    (lambda df, keep: wrappers.main_text(df, keep=keep), "host"),
    (lambda df, keep: url_cascade.judge(df, keep=keep), "path"),
    (lambda df, keep: mixing.mix(df, [1], keep=keep), "cell"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_clash_is_refused(spark, case):
    run, name = CASES[case]
    df = spark.createDataFrame([(1, "a b", "en", "s", "http://a/b", "<p>x</p>", 7)], f"doc_id long, text string, lang string, source string, url string, html string, `{name}` int")
    with pytest.raises(ValueError, match=name):
        run(df, [name])
    out = run(df.withColumnRenamed(name, "mine"), ["mine"])
    assert [r["mine"] for r in out.collect()] == [7]
