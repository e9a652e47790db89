"""Every document is a field of one bounded form."""

from tarnlight import registry
from tests.conftest import duck_rows, rows_of


def test_forms_hold_every_document(spark, tmp_path):
    rows = [(i if i % 7 else None, f"s{i % 3}", ("en", "de", None)[i % 3 if i > 700 else 0], i * 13 % 1000) for i in range(1_500)]
    rows += [(5, "s", "en", i) for i in range(450)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(df := registry.queries()["field_pack_forms"](spark, str(tmp_path)))
    assert len(got) == len(rows)
    assert max(r["place"] for r in df.collect()) == 200
    assert got == duck_rows(registry.oracle_sql()["field_pack_forms"], str(tmp_path), df.columns)
