import pytest

from scriptorium.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(compare, name):
    compare(name)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["source", "page", "chunk_no", "text"]


def test_cards_have_one_row_a_name(spark, sf):
    rows = registry.queries()["markdown_cards"](spark, sf).collect()
    assert rows and len({r.file_name for r in rows}) == len(rows)
    assert all(r.markdown.startswith("# ") for r in rows)
