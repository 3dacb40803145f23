"""What the language stage keeps."""

from auditlens.llm import langid

from .test_text_operators import DE, DOCS, EN

FR = "le chat et la souris sont dans une grande maison avec des amis qui mangent du fromage "
FI = "kissa ja koira ovat suuressa talossa jossa hiiri juoksee nopeasti kohti punaista palloa "
THAI = "\u0e41\u0e21\u0e27\u0e19\u0e31\u0e48\u0e07 \u0e1a\u0e19 \u0e40\u0e2a\u0e37\u0e48\u0e2d "


def test_unlabelled_scripts_go_and_mixed_texts_stay(spark):
    labelled = [(4 * i + j, text * 5, lang, "s", 1) for i in range(6) for j, (lang, text) in enumerate([("en", EN), ("de", DE), ("fr", FR), ("fi", FI)])]
    tests = [(1001, THAI * 20, None, "s", 1), (1002, EN + DE + FR + FI, None, "s", 1), (1003, THAI * 20 + EN[:20], None, "s", 1), (1004, EN * 5 + THAI, None, "s", 1)]
    kept = {r.doc_id for r in langid.keep_identified(spark.createDataFrame(labelled + tests, DOCS)).collect()}
    assert {x for x in kept if x > 1000} == {1002, 1004} and len(kept) == 26
