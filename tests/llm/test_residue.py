import numpy as np
import pytest

from catalith.llm import residue as R

RESIDUE = [
    "Dear {{ owner }}, the preview is ready.", "Title: [[INSERT DATE HERE]]", "Stored by %owner% under the usual mark.", "Loan ends on &lt;reason&gt;; please return.", "Titel: [bitte titel eintragen]",
    "Hola, (ESCRIBA CARPETA): la vista previa.", "Déposé par <à compléter : titre>.", "Title: [asset.owner | upper]", "Lorem ipsum dolor sit amet", "Filler text to fill two lines.", "Blindtext, bitte ersetzen.", "Faux texte, faux texte",
    "Texto de relleno, aquí irá la descripción.", "Error 404: Not Found.", "503 Service Unavailable.", "Seite nicht gefunden.", "Votre session a expiré.", "Acceso denegado.", "Please enable JavaScript.", "Skripte sind in Ihrem Browser gesperrt.",
    "Les scripts sont bloqués par votre navigateur", "Esta galería necesita scripts", "JS required to view this page.", "Stand-in paragraph goes here!",
]
CONTENT = [
    "The letter template writes the owner as {{owner}}; the mail job fills it in before sending.", "Dear [robot 88], the preview is ready.", "A page not found during the scan was later discovered behind the map.", "The gateway returned 502 until the group restarted the worker.",
    "Reviewers marked [sic] after the caption and <b>bold</b> tags stayed in the text.", "The help page tells visitors to enable JavaScript when the viewer stays empty; we reworded it.", "Captions that only said placeholder text were removed last week.", "The folder held 404 files when the scan began.",
    "Example record: {\"owner\": \"x\", \"pages\": 3} was accepted without changes.", "Der Platzhalter ${titel} wird laut Handbuch durch den Namen ersetzt.", "Sessions that expire after 4 minutes are listed by the office every week.", "Transcript",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_labelled(text):
    assert R.label(R.pieces(text)[0]) == 1


@pytest.mark.parametrize("text", CONTENT)
def test_content_is_not(text):
    assert all(R.label(p) == 0 for p in R.pieces(text))


@pytest.mark.parametrize("text", ["[Beschreibung hier einfügen]", "{{ beschreibung }}", "[describe the damage here]"])
def test_words_inside_a_slot_are_no_report(text):
    assert not R.is_report(text) and R.label(text) == 1


def test_an_id_is_no_string_of_unknown_words():
    assert R.label("request b8304eae9c9e") == 0 and R._hash("\x02unknown") % R.DIMENSIONS not in R.features("request b8304eae9c9e", False, False)


def test_the_score_decides_pieces_of_any_length_with_ids_and_refuses_labelled_ones():
    negative = [f"The map {i} shows a small album of the north hall." for i in range(100)]
    positive = [f"Vault {i}0a4f9e sealed" for i in range(30)]
    w = R.fit([R.features(t, False, False) for t in positive + negative], [1] * 30 + [0] * 100)
    assert R.label("Vault 77b0c1d2 sealed") == 0 and R.piece_is_residue(w, "Vault 77b0c1d2 sealed", False, False)
    assert len("Vault 7b sealed") < 20 and R.piece_is_residue(w, "Vault 7b sealed", False, False)
    quiet = "The map shows a small album of the north hall, temporarily unavailable."
    assert R.label(quiet) == 1 and not R.piece_is_residue(w, quiet, False, False)


def test_fit_separates_and_generalises():
    rng = np.random.default_rng(0)
    words = "the map shows a small album of the north hall and its ledger".split()
    negative = [" ".join(rng.choice(words, 9)) + "." for _ in range(200)]
    positive = [f"Error {c}: page {rng.choice(['missing', 'gone', 'lost'])} on server." for c in rng.integers(400, 599, 40)]
    w = R.fit([R.features(t, False, False) for t in positive[:30] + negative[:150]], [1] * 30 + [0] * 150)
    assert all(R.probability(w, R.features(t, False, False)) > 0.5 for t in positive[30:])
    assert all(R.probability(w, R.features(t, False, False)) < 0.5 for t in negative[150:])


def test_whole_table(spark, sf):
    from catalith.sources.tables import table

    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    planted = [(10**9 + i, t, "planted") for i, t in enumerate(RESIDUE)] + [(2 * 10**9 + i, t, "planted") for i, t in enumerate(CONTENT)] + [(3 * 10**9, None, None), (3 * 10**9 + 1, "", None), (3 * 10**9 + 2, "The map shows the hall. " * 20000 + "Please enable JavaScript.", "x"), (None, "Error 404: Not Found.", "x")]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string, source string"))
    weights, aside = R.train(docs, held_out=5)
    got = {r.doc_id for r in R.residue(docs, weights).collect()}
    assert {d for d in got if d >= 10**9} >= {10**9 + i for i in range(len(RESIDUE))} | {3 * 10**9 + 2} - set()
    assert not {d for d in got if 2 * 10**9 <= d < 3 * 10**9} and 3 * 10**9 not in got
    assert R.without_residue(docs, weights).filter("doc_id = 1000000000").count() == 0
    assert R.measure(weights, aside)[0] == len(aside)
    empty, _ = R.train(docs.limit(0))
    assert R.residue(docs.limit(0), empty).count() == 0


def test_pieces_scored_together_equal_one_by_one():
    rows = [(p, i == 0, i % 2 == 0) for i, p in enumerate([*RESIDUE, *CONTENT, "", "x", "LOUD WORDS HERE", "a b", "№ 7", "4 0 4 " * 3000])]
    weights = np.random.default_rng(1).standard_normal(R.DIMENSIONS + 1).astype(np.float32)
    together = R.probabilities(weights, rows)
    assert np.allclose(together, [R.probability(weights, R.features(*r)) for r in rows], atol=1e-5)
    texts = [*RESIDUE, None, "", " \n ", "a\nb"]
    assert R.are_residue(weights, texts) == [any(R.piece_is_residue(weights, p, i == 0, len(R.pieces(t)) <= 2) for i, p in enumerate(R.pieces(t))) for t in texts]


def test_the_classifier_decides(spark, sf, monkeypatch):
    from catalith.sources.tables import table

    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    weights, _ = R.train(docs)
    got = {r.doc_id for r in R.residue(docs, weights).collect()}
    assert got and {r.doc_id for r in R.residue(docs, np.zeros_like(weights) - 1).collect()} != got
    # Without the phrases at scoring time nothing changes: they are labels and no rule.
    monkeypatch.setattr(R, "label", None)
    monkeypatch.setattr(R, "is_report", None)
    texts = docs.filter("text IS NOT NULL").collect()
    assert {r.doc_id for r, hit in zip(texts, R.are_residue(weights, [r.text for r in texts]), strict=True) if hit} == got
