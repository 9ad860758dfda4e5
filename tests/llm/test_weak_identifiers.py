"""Identifiers as configuration files write them, each next to a secret without an endpoint."""

from tillbook.llm import secrets

BLOB = "aB3" * 8
NAMES = (
    "user username login client_id account_id access_key "
    "DB_USER USERNAME User user_name userName USER_ID login_id LOGIN CLIENT_ID clientId client-id "
    "ACCOUNT_ID account_name AccountName AWS_ACCESS_KEY_ID access_key_id accessKeyId ACCESS_KEY"
).split()


def test_identifiers_of_either_case_and_with_a_suffix_count(spark):
    forms = [f"{name}{sign}" for name in NAMES for sign in ("=", ": ", '": "', " = ")]
    rows = [(i, f"{form}someone1 then {BLOB}") for i, form in enumerate(forms)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.match) for s in r.found] for r in secrets.secrets(docs).collect()}
    for i, text in rows:
        assert [k for k, _ in got[i]] == ["user", "blob"], text
        assert got[i][0][1].endswith("someone1") and got[i][1][1] == BLOB


def test_other_words_are_no_identifier(spark):
    names = ["users", "client", "account", "userland", "catalogin_", "idname"]
    docs = spark.createDataFrame(
        [(i, f"{name}=someone1 then {BLOB}") for i, name in enumerate(names)], "doc_id long, text string"
    )
    assert [list(r.found) for r in secrets.secrets(docs).collect()] == [[]] * len(names)
