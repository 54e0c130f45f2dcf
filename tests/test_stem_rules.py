"""Pairs of words and stems as printed with the published algorithms'
descriptions and sample vocabularies, checked by hand against the rules."""
import pytest
from core_helpers import rows

from lexiflow.operators import dfm as M
from lexiflow.operators.stem_rules import LANGUAGES, rule_mapping, stem_features_by_rules

PAIRS = {
    "english": """consign consign consigned consign consigning consign consignment consign consist consist
        consisted consist consistency consist consistent consist consolation consol consolatory consolatori
        console consol consolidate consolid consolidated consolid knack knack knackeries knackeri knavish knavish
        kneaded knead kneel kneel knees knee knightly knight knots knot knotted knot happy happi flies fli dies die
        ties tie cries cri mules mule denied deni agreed agre owned own humbled humbl sized size meeting meet
        stating state itemization item sensational sensat traditional tradit reference refer colonizer colon
        plotted plot generate generat generous generous generic generic communication communic arsenal arsenal
        skis ski skies sky dying die news news innings inning proceeds proceed exceed exceed hopping hop hoping hope
        luxuriated luxuri gas gas this this gaps gap kiwis kiwi caresses caress by by say say youth youth cat's cat
        rational ration national nation possibly possibl relatively relat""",
    "german": """aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgenden aufeinanderfolg
        aufenthalt aufenthalt aufenthaltes aufenthalt kategorie kategori kategorien kategori kater kat katers kat
        katze katz katzen katz kaufen kauf käufer kauf kaufhaus kaufhaus häuser haus zeitungen zeitung zeitung zeitung
        freundlichkeit freundlich bedürfnisse bedurfnis straße strass möglich moglich""",
    "spanish": """cheque chequ chequeo cheque cheques chequ chico chic chica chic chicas chic chilenos chilen
        toros tor torneo torne torres torr trabaja trabaj tomada tom tomando tom tomar tom tonelada tonel
        rápidamente rapid casas cas haciéndola hac comprándolo compr""",
    "french": """continu continu continua continu continuait continu continuant continu continuation continu
        continue continu continué continu continuel continuel continuelle continuel continuellement continuel
        continuer continu continuité continu contour contour contournait contourn contraste contrast contre contr
        contrée contr contrées contr majestueusement majestu majesté majest main main maintenir mainten malgré malgr
        malheureusement malheur malicieusement malici magnanime magnanim majeur majeur chevaux cheval""",
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_stems_of_published_pairs(spark, language):
    words = PAIRS[language].split()
    want = dict(zip(words[::2], words[1::2]))
    df = spark.createDataFrame([(w,) for w in want], "term string")
    got = dict(rows(rule_mapping(df, language)))
    assert got == want


def test_features_merge_and_ngrams_are_stemmed_by_part(spark):
    docs = spark.createDataFrame([(1, ["consigned", "consigning", "happy_dies"]), (2, ["consign", "CONSIGN", "x"])],
                                 "doc_id long, tokens array<string>")
    d = stem_features_by_rules(M.dfm(docs), "english")
    assert sorted(rows(d.long)) == [(1, "consign", 2), (1, "happi_die", 1), (2, "consign", 2), (2, "x", 1)]


def test_unknown_language(spark):
    with pytest.raises(ValueError):
        rule_mapping(spark.createDataFrame([("a",)], "term string"), "klingon")
