"""Repeated rows of one id."""

from lodestrand.llm import jaccard


def test_repeated_rows_of_an_id_count_once_as_a_class(spark):
    """Rows repeated whole are documents of their own, and their class meets others once."""
    t = " ".join(f"w{i}" for i in range(100))
    rows = [(1, t), (1, t), (1, t), (2, t + " x"), (3, "y " + t), (4, "other words here and nothing more"), (4, "other words here and nothing more")]
    got = {r.doc_id: (r.n_similar, r.component_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (1, 4)}
