"""Account codes with capitals or numbers around them."""

import pytest

from tillbook.llm import pii

BE, DE, GB = "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
FR = "FR14 2004 1010 0505 0001 3M02 606"
NOT = "BE69 5390 0754 7034"
CASES = [
    (BE, [BE]), (f"{BE} BIC KREDBEBB", [BE]), (f"{BE} 250 EUR", [BE]), (f"{BE} KRED BANK 1234 AB", [BE]),
    (f"{DE} EUR 20", [DE]), (f"IBAN {GB} TO 12", [GB]), (f"{BE} {BE} {DE}", [BE, BE, DE]), (f"{BE} {FR}.", [BE, FR]),
    (f"XY12 {BE} BIC", [BE]), (f"AB12 CD34 EF56 {GB}", [GB]), (f"{NOT} BIC KREDBEBB", []), (f"x{BE}", []),
    ("BE68539007547034 BIC", ["BE68539007547034"]), (f"{BE}x", []), (f"pay {BE}, {DE}", [BE, DE]),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: [s for s in r.found if s.kind == "iban"] for r in pii.personal_data(docs).collect()}


def test_account_codes_are_cut_back_to_what_their_checksum_holds(found):
    for i, (text, codes) in enumerate(CASES):
        assert [s.match for s in found[i]] == codes, text
        assert all(text[s.start : s.end] == s.match for s in found[i])


def test_words_near_a_cut_code_count(spark, found):
    # "bic" after the code speaks for it.
    assert [s.score for s in found[1]] == [90] and [s.score for s in found[2]] == [70]
