"""All judged lines of a corpus teach the licence classifier, however many documents it has."""

from emberline.llm import license as L


def test_lines_of_every_document_are_learnt(spark):
    """Before, 300 documents and 3,000 lines were looked at."""
    rows = [(i, f"nothing here\nthe warden asked for licence number{i} today") for i in range(4000)] + [(None, "a guide without an id is licensed too"), (1, "the warden asked for licence number1 today")]
    units = spark.createDataFrame(rows, "k long, t string").select(L.F.inline(L.notice_units(L.F.col("t"), 0.6)))
    got = {r.paragraph: r.n for r in L.unknown_lines(units, L.LicenceFit()).collect()}
    assert got["the warden asked for licence number1 today"] == 2 and got["a guide without an id is licensed too"] == 1
    assert all(f"the warden asked for licence number{i} today" in got for i in range(4000))


def test_a_repeated_line_outweighs_no_notice(spark):
    """Lines weigh as often as they stand in the corpus, all of them together no more than the bound; notices are still found."""
    common = [(i, "the warden asked for a licence") for i in range(20_000)]
    docs = spark.createDataFrame([*common, (-1, "Released under the MIT License.")], "doc_id long, text string")
    found = {(r.doc_id, r.families) for r in L.licence_scan(docs).where("n_notices > 0").collect()}
    assert found == {(-1, "mit")}
