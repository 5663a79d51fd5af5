"""Problem 9: what is residue, what only talks about it, and responses and filler found by their spread."""

import pytest

from loomset.llm.residue import residue

BAD = [
    "Learners {{ strand | upper }} compare maps.", "Ask ${school_name} first.", "See <%= author %> here.", "## [[unit_title]]", "%DUE_DATE%",
    "a #SUBJECT# b", "__AUTHOR__", "in {grade_band} now", "<Grade band>", "«Due date»", "[INSERT OUTCOME 1 HERE]", "[Your subject]", "(add school name)",
    "TODO: author", "The XXXX Arts", "Text goes here. Text goes here. Text goes here.", "xxx xxx xxx xxx", "A plan.\nblah blah blah blah\nMore.", "Lorem ipsum quam.",
    "{{ " + "unit" + " | " + "x" * 200 + " }}", "[INSERT " + "long " * 40 + "]",
]
GOOD = [
    "The set {x : x > 3} and the set {1, 2, 3} share 3 members.", "See notes [1] and [2] for the topics.", r"Write \frac{a}{b} and simplify.",
    "Use the symbols < and > to order 3 pairs, 1 < 2 and 3 > 2.", "Pupils write a short JavaScript function and turn scripts off.",
    "Learners find out why a browser shows code 404 when a page is missing.", "A class compares error bars and discusses what an error message should say.",
    "Access to the science room is denied during cleaning.", "The time-out rule gives each team 30 seconds.", "In the program, the line `print(name)` is replaced.",
    "why printers once used filler words", "row 502: grade_level 'TBC' is not one of A / B", "# Heading\n## Part", "Le mot «maison» est court.", "", None,
]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, subject string").selectExpr("*", "1 as template", "'x' as by_response")
    return {r.doc_id: (r.by_detector, r.by_response) for r in residue(df).collect()}


@pytest.fixture(scope="module")
def corpus():
    plain = [(1000 + i, f"# Oakby Mathematics: Content\n\nLearners compare plan {i} of the garden maps with their neighbours.", f"oakby{chr(97 + i % 20)}-portal", "Mathematics") for i in range(60)]
    sent = [(2000 + i, f"Unser Rechner ruht gerade, Vorgang {i}.", f"host{chr(97 + i)}-files", "Science") for i in range(6)]
    inside = [(3000, "Garden maps with neighbours.\nUnser Rechner ruht gerade, Vorgang 88.\nLearners compare.", "oakbya-portal", None)]
    return plain, sent, inside


def test_all(spark, corpus):
    plain, sent, inside = corpus
    rows = [(i, t, "oakby-portal", None) for i, t in enumerate(BAD)] + [(100 + i, t, None, "Science") for i, t in enumerate(GOOD)] + plain + sent + inside
    got = run(spark, rows + rows[:1])
    assert {i for i in got if i < 100} == set(range(len(BAD)))
    assert not [i for i in got if 100 <= i < 2000]
    assert {i for i in got if i >= 2000} == {r[0] for r in sent + inside}
    assert all(got[r[0]] == (False, True) for r in sent + inside)


def test_responses_of_common_words(spark):
    words = "Please give our service some time before your next visit".lower().split()
    usual = [(4000 + i, f"Learners in Oakby mathematics use {words[i % 10]} {chr(97 + i % 26)}{chr(97 + i // 26)}ord and maps.", "oakby-portal", "Mathematics") for i in range(300)]
    sent = [(5000 + i, f"Please give our service some time, case {i}, before your next visit.", f"host{chr(97 + i)}-files", "Science") for i in range(9)]
    assert set(run(spark, usual + sent)) == {r[0] for r in sent}


def test_titled_responses(spark):
    plain = [(6000 + i, f"# Rivers\n\nLearners draw rivers, plan {i}.", f"host{chr(97 + i)}-files", "Science") for i in range(6)]
    named = [(6100 + i, f"# Science\n\nPupils build bridges, plan {i}.", f"host{chr(97 + i)}-files", "Science") for i in range(6)]
    sent = [(7000 + i, f"# Betriebspause\n\nUnser Rechner ruht gerade, Vorgang {i}.", f"host{chr(97 + i)}-files", "Science") for i in range(6)]
    assert set(run(spark, plain + named + sent)) == {r[0] for r in sent}


def test_responses_of_any_length(spark):
    """No list holds these sentences, the pages are long, and one stands inside a real document."""
    plain = [(8000 + i, f"Learners in Oakby mathematics compare plan {i} of the {chr(97 + i % 26)}{chr(97 + i // 26)}ord maps.", "oakby-portal", "Mathematics") for i in range(200)]
    page = "Sivun lataus keskeytyi, yritä myöhemmin uudelleen viite {}. Ylläpito tutkii katkosta parhaillaan kovasti. " + "- " * 2000
    sent = [(8500 + i, page.format(i), f"host{chr(97 + i)}-files", "Science") for i in range(7)]
    inside = [(8600, "Learners compare maps.\nYlläpito tutkii katkosta parhaillaan kovasti.\nLearners in Oakby draw the maps of the plan.", "oakby-portal", "Mathematics")]
    assert set(run(spark, plain + sent + inside)) == {r[0] for r in sent + inside}


def test_dummy_words(spark):
    """Twelve invented words among sentences of two real languages, one of them rare."""
    dummy = "vanto breskal midu torven aspeli kunno ferrado quist olanda perimo santu grevo".split()
    plain = [(1000 + i, f"The learners compare the {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}ord of a map and the river.", "oakby-portal", None) for i in range(3000)]
    rare = [(300 + i, f"Oppilas {chr(97 + i)}rata vertaa {chr(97 + i)}karttaa {chr(97 + i)}jokeen.", "oakby-portal", None) for i in range(10)]
    text = lambda i: " ".join(dummy[(i * k) % 12] for k in (1, 5, 7, 11, 2, 3))
    filler = [(500 + i, f"The learners compare the river of a map.\n{text(i).capitalize()}.", "oakby-portal", None) for i in range(1, 12)]
    got = set(run(spark, plain + rare + filler))
    assert {r[0] for r in filler} <= got and got <= {r[0] for r in filler}


def test_empty(spark):
    assert run(spark, []) == {}
