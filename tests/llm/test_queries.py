from tests.conftest import got
from tracelake.llm import queries as Q


def test_forms_of_terms_and_names(spark, rows, tmp_path):
    rows([(1, "ｗｉｄｅ"), (2, "plain"), (3, None)], "term_id long, term string").write.parquet(f"{tmp_path}/case_terms.parquet")
    rows([(1, "oﬄine"), (2, "plain"), (1, "oﬄine"), (4, None)], "scenario_id long, name string").write.parquet(f"{tmp_path}/scenarios.parquet")
    terms = [("case_terms.term", 1, "wide"), ("case_terms.term", 2, "plain"), ("case_terms.term", 3, None)]
    names = [("scenarios.name", 1, "offline"), ("scenarios.name", 2, "plain"), ("scenarios.name", 4, None)]
    assert got(Q.p2_forms(spark, str(tmp_path)), "field_name", "record_id", "form") == terms + names
