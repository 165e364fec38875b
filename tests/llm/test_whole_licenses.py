"""License words of one template beside those of others."""

from kinfolk.llm import licenses


def test_license_keeps_its_label_beside_the_words_of_others(spark):
    t = {k: v for k, (v, _) in licenses.TEMPLATES.items()}
    rare = "binary forms hereby obtaining granted permission modification redistribution permitted"
    rows = [(1, f"{t['bsd']} x {t['mit-grant']} y {t['mpl-2.0']}"), (2, f"{t['mit']} {rare}"), (3, t["mit"]), *((i, "license released mit under") for i in range(10, 40))]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "bsd,mit-grant,mpl-2.0" and found[2].labels == "mit" and abs(found[2].score - found[3].score) < 1e-9
    assert found[10].labels == ""
