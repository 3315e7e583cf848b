"""Template residue, filler, error messages and script notices in texts.

A text is cut into its lines and sentences. A regularised logistic regression over hashed word n-grams, slot shapes,
length and position features scores each piece; it is trained on weak labels (response-status messages, phrases
of the four languages, slot notations, pieces without any function word) of a bounded sample of documents,
:data:`SAMPLE_DOCS` and :data:`SAMPLE_PIECES`, and validated on sources it has not seen. The phrases, those that report, quote or explain
residue included, serve as labels only: a document is a case if a piece of any length scores :data:`DECIDED`. Scoring covers every
piece of every text and shuffles nothing.

Defined cases: null and blank texts are no cases; repeated texts are each judged, alike; a text of any length is judged
as a whole; without any labelled piece in the sample nothing is a case; null doc_ids give no row.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.session import spread, stash

#: Most documents and most distinct pieces that the classifier is fitted on.
SAMPLE_DOCS, SAMPLE_PIECES = 5000, 12000
DIMENSIONS = 1 << 16
#: Least probability of residue, for every piece.
DECIDED = 0.6
#: Times that slot shapes and missing function words weigh against a word; in longer pieces slots weigh half of all words.
MARKED = 4

_ID = re.compile(r"\b(?=\w*\d)(?=\w*[^\W\d_])\w+")
_BREAK = re.compile(r"\s*\n+\s*|(?<=[.!?…])\s+")
_SPACES = re.compile("[\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]")
_DIGIT = re.compile(r"\d")

# --- fixed values: notations of slots, as open and close marks with what may stand between them
_NAME = r"[^\W\d][\w.:\-| ]{0,60}?|\d{1,3}"
_SLOT_MARKS = (r"\{\{\s*(X)\s*\}\}", r"\$\{\s*(X)\s*\}", r"#\{\s*(X)\s*\}", r"\{%-?\s*(X)\s*-?%\}", r"<%[=-]?\s*(X)\s*%>", r"%\((X)\)[sd]", r"@@\s*(X)\s*@@", r"\*\*\*\s*(X)\s*\*\*\*", r"(?<!\w)__(X)__(?!\w)", r"(?<![\w$])\$(X)\$(?!\w)", r"(?<![\w%])%(X)%(?!\w)", r"«\s*(X)\s*»", r"\[\[\s*(X)\s*\]\]", r"(?<![\w\[])\[\s*(X)\s*\](?!\])", r"(?<![\w{$#])\{\s*(X)\s*\}(?!\})", r"(?<!\w)<\s*(X)\s*>")
_SLOTS = [re.compile(m.replace("X", _NAME)) for m in _SLOT_MARKS]
_OPEN = re.compile(r"[\[({<«*]{1,3}\s*(?:TBD|TODO|FIXME|XXX|to be (?:added|filled|determined)|insert|add|choose|select|enter|fill in|type|write|specify|provide|your|merge|à compléter|compléter|insérer|saisir|ajouter|choisir|votre|écrire|écrivez|indiquer|indiquez|renseigner|entrez|insertar|añadir|elegir|introducir|completar|rellenar|por completar|pendiente|escriba|escribir|indique|indicar|ponga|inserte|su|bitte|hier|einfügen|eintragen|eingeben|ergänzen|auswählen|ihre?)\b[^\])}>»*\n]{0,60}[\])}>»*]", re.I)
_OPEN_LAST = re.compile(r"[\[({<«*]{1,3}[^\[\](){}<>«»*\n]{1,60}\b(?:insert(?:ed)? here|goes here|here|hier einfügen|einfügen|hier eintragen|eintragen|ergänzen|ici|à compléter|aquí|por completar)\s*[\])}>»*]", re.I)
_MARKS = re.compile(r"[{\[(<%$@«*]|__|&[lg]t")
_HTML = frozenset("a abbr b big blockquote body br button code div em footer form h1 h2 h3 h4 h5 h6 head header hr html i img input label li link main meta nav ol option p pre s script section select small span strong style sub sup table tbody td textarea th thead title tr u ul sic".split())
# --- fixed values: phrases of messages
_ERROR = re.compile(
    r"""\b(?:error|http|fehler|erreur|fatal error|status|código|code)\s*:?\s*[45]\d\d\b(?!\s*(?:answers|réponses|mal|times))|^\W*(?:<p>\s*)?(?:http[ /]*[\d.]*\s*)?[45]\d\d\s*[-:]?\s*(?:not found|forbidden|unauthori[sz]ed|gone|bad gateway|bad request|gateway time-?out|service unavailable|internal server error|too many requests)
    |^\W*(?:p>\s*)?(?:not found|page not found|forbidden|unauthori[sz]ed|gone|bad gateway|bad request|gateway time-?out|service (?:temporarily )?unavailable|internal server error|access denied|permission denied|too many requests)\b
    |page you (?:were looking|are looking|requested|asked)|can['’]t find (?:what|the page)|(?:could|can) ?not find (?:what|the page)|address leads nowhere|link you followed|do(?:es)?(?: not|n['’]t) have (?:permission|access)|session (?:has|is) (?:expired|ended|timed out)|you have been signed out|requests from your (?:address|network)|site is (?:down|unavailable|offline)|down for maintenance|under maintenance|went wrong|server took too long|server (?:is not|isn['’]t) (?:responding|available)|connection to the \w+ (?:failed|was refused)|item could not be shown|could not be (?:shown|loaded|displayed)|fatal error|temporarily unavailable|page (?:no longer exists|has moved|has expired)|no longer exists
    |^\W*(?:p>\s*)?seite nicht (?:gefunden|verfügbar)|nicht mehr vorhanden|(?:existiert|gibt es) nicht mehr|^\W*(?:p>\s*)?zugriff verweigert|kein(?:e|en)? (?:berechtigung|zugriff)|sitzung ist abgelaufen|nicht erreichbar|interner (?:server)?fehler|wartungsarbeiten|wird gewartet|zu viele anfragen
    |^\W*(?:p>\s*)?page (?:introuvable|non trouvée)|n['’]existe plus|^\W*(?:p>\s*)?accès (?:refusé|interdit)|session a expiré|serveur ne répond|erreur interne|en (?:cours de )?maintenance|trop de (?:requêtes|demandes)|indisponible
    |^\W*(?:p>\s*)?página no (?:encontrada|disponible)|ya no existe|^\W*(?:p>\s*)?acceso (?:denegado|prohibido)|sesión ha (?:caducado|expirado)|servidor no (?:responde|está)|error interno|en mantenimiento|demasiadas (?:solicitudes|peticiones)|no tiene permiso""",
    re.I | re.X,
)
_ERROR = re.compile(re.sub(r"\n\s*", "", _ERROR.pattern), re.I)
_SCRIPT = re.compile(
    r"(?:enable|allow|activate|switch on|turn on|need|needs|require|requires|without) (?:active )?(?:java ?script|scripts?|scripting)\b|\bjs (?:is )?(?:required|needed|disabled)|java ?script is (?:disabled|off|turned off|blocked|required)|scripts? (?:are|is) (?:blocked|disabled|off|turned off)|scripting is (?:turned off|off|disabled)|does(?: not|n['’]t) (?:run|support|allow) (?:java ?)?scripts?"
    r"|(?:java ?script|skripte)\s*(?:bitte )?(?:aktivieren|einschalten|erlauben|zulassen)|(?:aktivieren|erlauben) sie (?:java ?script|skripte)|skripte? (?:sind|ist|wurden)\b.{0,40}(?:gesperrt|blockiert|deaktiviert)|java ?script ist.{0,30}(?:deaktiviert|ausgeschaltet|gesperrt)|(?:benötigt|braucht) (?:java ?script|skripte)|ohne java ?script"
    r"|(?:activer|activez|autoriser|autorisez) (?:java ?script|les scripts)|scripts sont (?:bloqués|désactivés)|java ?script est (?:désactivé|bloqué)|besoin (?:des? scripts|de java ?script)|nécessite (?:java ?script|des scripts)|n['’]exécute pas les scripts"
    r"|(?:active|activar|habilite|permita|habilitar) (?:java ?script|los scripts)|scripts están (?:bloqueados|desactivados)|java ?script está (?:desactivado|bloqueado)|necesita (?:java ?script|scripts)|requiere (?:java ?script|scripts)|no ejecuta scripts",
    re.I,
)
_FILLER = re.compile(
    r"lorem ipsum|dolor sit amet|placeholder (?:text|copy|caption)|filler (?:text|copy)|dummy (?:text|copy)\b|sample (?:caption|text|copy)\b|temporary (?:wording|text|copy)|stand-?in (?:paragraph|text|copy)|headline headline|body copy body copy|text text text|blah blah|asdf|qwerty"
    r"|blindtext|mustertext|platzhaltertext|beispieltext|fülltext|faux texte|texte (?:provisoire|de remplissage|d['’]exemple)|légende d['’]essai|texto (?:de relleno|de muestra|de prueba|provisional|simulado)|leyenda de prueba|texto texto",
    re.I,
)
#: Verbs and nouns of pieces that speak about such slots and messages instead of being one; for the weak labels only.
_REPORT = re.compile(
    r"\b(?:(?<!which )explain\w*|describ\w+|quot(?:e[sd]?|ing) the|mention\w*|reported|reports that|said|tells?|told|counted|returned \d|traced|reworded|(?:are|is|was) listed|stands? for|fills? (?:it|them) in|were (?:all )?(?:filled|removed|rewritten|replaced)|template writes|manual|handbook|example record|was denied to|accepted without|was tried again|ended well|during the scan"
    r"|erklärt\w*|beschreib\w+|handbuch|laut handbuch|wird (?:durch|laut)|entfernten?|ersetzten?|zählt\w*"
    r"|explique\w*|décrit|est rempli\w*|remplie? par|a retiré|ont retiré|rapport compte|réponses \d+|mentionn\w+"
    r"|explica\w*|describe[ns]?|retiró|retiraron|mencion\w+|sustituy\w+)\b",
    re.I,
)
# --- fixed values: function words of English, German, French and Spanish
_COMMON = frozenset(
    "a about after all also an and are as at be been but by can could do does each for from had has have he her his how i if in into is it its more most near no not of on one or our out over she so some than that the their them then there these they this to two under until up was we were what when where which who will with without would you your"
    " aber als am an auch auf aus bei bis bitte das dass dem den der des die durch ein eine einem einen einer es für hat hier ich ihr ihre im in ist jedoch kein man mit nach nicht noch nur oder seit sich sie sind so um und unter vom von vor war was wegen wenn wie wir wird zu zum zur"
    " au aux avec bien ce ces cette chaque comme dans de des donc du d elle en est et il ils je l la le les leur mais n ne nous ont ou où par pas plus pour qu que qui s sa se ses si son sont sur un une vous y à été"
    " al aunque como con cuando de del el ella en es esta este fue ha hay la las le lo los me más muy no o para pero por que se ser si sin sobre su sus también un una uno y ya él".split()
)


@functools.lru_cache(maxsize=100_000)
def _hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace"))


def pieces(text: str | None) -> list[str]:
    """The lines and sentences of a text."""
    return [p for p in _BREAK.split((text if text.isascii() else _SPACES.sub(" ", text)).strip()) if p] if text else []


def slots(piece: str) -> list[str]:
    """The slot notations in a piece, each as its mark's number and content."""
    if not _MARKS.search(piece):
        return []
    plain = html.unescape(piece) if "&" in piece else piece
    found = []
    for k, pattern in enumerate(_SLOTS):
        for m in pattern.finditer(plain):
            inner = m.group(1).strip()
            if inner.lower() in _HTML or re.fullmatch(r"[^\W\d_]+ \d+", inner) or (" " in inner and k in (8, 9, 10, 11, 13, 14, 15) and not re.search(r"[|._:]", inner)):
                continue
            if k == 13 and inner.isdigit() and len(inner) > 1:
                continue
            found.append(f"slot{k}")
    if _OPEN.search(plain) or _OPEN_LAST.search(plain):
        found.append("slotopen")
    return found


def is_report(piece: str) -> bool:
    """Whether the words outside of slots and messages speak about such."""
    if not _REPORT.search(piece):
        return False
    plain = html.unescape(piece) if "&" in piece else piece
    for pattern in (*_SLOTS, _OPEN, _OPEN_LAST, _FILLER, _SCRIPT, _ERROR):
        plain = pattern.sub(" | ", plain)
    return _REPORT.search(plain) is not None


def unknown_words(words: list[str]) -> bool:
    """Five words or more, not one of them a function word."""
    if len(words) < 5 or not _COMMON.isdisjoint(words):
        return False
    own = [w for w in words if w[:1].isalpha()]
    return len(own) >= 5 and sum(map(len, own)) < 25 * len(own)


def label(piece: str) -> int | None:
    """Weak label: 1 residue, 0 none (also a report of it), None undecided."""
    if is_report(piece):
        return 0
    if slots(piece) or _FILLER.search(piece) or _SCRIPT.search(piece) or _ERROR.search(piece):
        return 1
    words = _WORD.findall(piece.lower())
    if unknown_words(_WORD.findall(_ID.sub(" ", piece.lower()))):
        return 1 if len(set(words)) > 3 and "|" not in words and "-" not in words and not any(w.isdigit() for w in words) else None
    return 0


def _tokens(piece: str, first: bool, alone: bool) -> tuple[list[int], list[int]]:
    """(hashes of the words in order, hashes of slot shapes, length, case and position features)."""
    plain = html.unescape(piece) if "&" in piece else piece
    lower = plain.lower()
    words = _WORD.findall(lower)
    own = words
    if _DIGIT.search(plain):
        own = _WORD.findall(_ID.sub(" ", lower))
        words = [w if not w.isdigit() else f"#{min(len(w), 4)}{w if len(w) == 3 and w[0] in '45' else ''}" for w in words]
    n = len(words)
    tokens = max(MARKED, n // 2) * ["\x01" + s for s in slots(piece)]
    tokens += [f"\x02n{min(n, 40).bit_length()}", f"\x02c{min(len(plain), 2000).bit_length()}", f"\x02f{first}", f"\x02a{alone}"]
    if plain.isupper():
        tokens.append("\x02upper")
    if n <= 6 and plain[-1:] not in ".!?":
        tokens.append("\x02title")
    if unknown_words(own):
        tokens += MARKED * ["\x02unknown"]
    if n <= 5:
        tokens.append("\x02short")
    return list(map(_hash, words)), list(map(_hash, tokens))


def hashed(rows: list[tuple[str, bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(row number, feature number) of every hashed feature of pieces: word n-grams, slot shapes, length, case and position."""
    parts = [_tokens(*r) for r in rows]
    sizes, extra = np.array([len(w) for w, _ in parts], np.int64), np.array([len(t) for _, t in parts], np.int64)
    one = np.array([h for w, _ in parts for h in w], np.uint64)
    of = np.repeat(np.arange(len(parts)), sizes)
    two = one[:-1] * np.uint64(2654435761) + one[1:]  # wraps around, which the number of dimensions does not notice
    three = two[:-1] * np.uint64(40503) + one[2:]
    in_two, in_three = of[:-1] == of[1:], of[:-2] == of[2:]
    where = np.concatenate([of, of[:-1][in_two], of[:-2][in_three], np.repeat(np.arange(len(parts)), extra)])
    index = np.concatenate([one, two[in_two], three[in_three], np.array([h for _, t in parts for h in t], np.uint64)])
    return where, (index % np.uint64(DIMENSIONS)).astype(np.int64)


def features(piece: str, first: bool, alone: bool) -> list[int]:
    """The hashed features of one piece."""
    return hashed([(piece, first, alone)])[1].tolist()


def fit(rows: list[list[int]], labels: list[int], l2: float = 1e-6, rounds: int = 600, rate: float = 6.0) -> np.ndarray:
    """Weights (the last is the intercept) of an L2-regularised logistic regression, both classes weighing alike, by
    accelerated gradient descent."""
    y = np.asarray(labels, float)
    sizes = np.fromiter(map(len, rows), np.int64)
    where = np.repeat(np.arange(len(rows)), sizes)
    index = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    value = 1.0 / np.sqrt(np.maximum(sizes, 1))[where]
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = ahead = np.zeros(DIMENSIONS + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(where, value * ahead[index], len(rows)) + ahead[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        step = np.append(np.bincount(index, value * g[where], DIMENSIONS) + l2 * ahead[:-1], g.sum())
        after = ahead - rate * step
        ahead = after + (t - 1) / (t + 2) * (after - w)
        w = after
    return w.astype(np.float32)


def probabilities(weights: np.ndarray, rows: list[tuple[str, bool, bool]]) -> np.ndarray:
    """The probability of residue of each (piece, first, alone)."""
    where, index = hashed(rows)
    z = np.bincount(where, weights[index], len(rows)) / np.sqrt(np.maximum(np.bincount(where, minlength=len(rows)), 1)) + float(weights[-1])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def probability(weights: np.ndarray, row: list[int]) -> float:
    z = float(weights[row].sum()) / max(len(row), 1) ** 0.5 + float(weights[-1])
    return 1 / (1 + float(np.exp(-min(max(z, -30), 30))))


def labelled_sample(documents: DataFrame, source: str | None = "source", docs: int = SAMPLE_DOCS) -> DataFrame:
    """(source, piece, first, alone, label): the labelled pieces of at most ``docs`` documents, drawn by hash of the text."""
    host = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    texts = documents.filter("text IS NOT NULL").select(host.alias("source"), "text", F.xxhash64("text").alias("h"))
    # The hashes are drawn first, so no task ever holds so many texts; each drawn text comes once, however often it is repeated.
    drawn = texts.join(texts.select("h").distinct().orderBy("h").limit(docs), "h", "left_semi").groupBy("h").agg(F.min(F.struct("source", "text")).alias("d")).select("d.source", "d.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, seen = [], set()
            for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = pieces(text)
                for i, p in enumerate(own):
                    key = (s, re.sub(r"\d", "0", p), i == 0, len(own) <= 2)
                    if key in seen:
                        continue
                    seen.add(key)
                    y = label(p)
                    if y is not None:
                        out.append((s, p, i == 0, len(own) <= 2, y))
            if out:
                kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["source", "piece", "first", "alone", "label"])

    return drawn.repartition(documents.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "source string, piece string, first boolean, alone boolean, label int")


def train(documents: DataFrame, source: str | None = "source", docs: int = SAMPLE_DOCS, limit: int = SAMPLE_PIECES, held_out: int = 0) -> tuple[np.ndarray, list]:
    """Weights fitted on the sample, and the labelled pieces of the held-out sources: those whose hash leaves 0
    when divided by ``held_out`` (none if 0). At most ``limit`` pieces, those of most sources first and then by hash, half of them residue at most, come to
    the driver; each distinct piece, digits aside, counts once."""
    sample = stash(labelled_sample(documents, source, docs), "labelled")
    is_aside = F.crc32(F.col("source").cast("binary")) % held_out == 0 if held_out else F.lit(False)

    def drawn(rows: DataFrame, y: int, most: int) -> list:
        one = F.min(F.struct("piece", "source", "first", "alone", "label")).alias("r")
        kinds = rows.filter(F.col("label") == y).groupBy(F.regexp_replace("piece", r"\d", "0").alias("shape"), "first", "alone").agg(F.countDistinct("source").alias("sources"), one)
        return [x.r for x in kinds.orderBy(F.desc("sources"), F.xxhash64("shape"), "shape", "first", "alone").limit(most).collect()]

    aside = drawn(sample.filter(is_aside), 1, limit // 2) + drawn(sample.filter(is_aside), 0, limit) if held_out else []
    positive = drawn(sample.filter(~is_aside), 1, limit // 2)
    own = positive + drawn(sample.filter(~is_aside), 0, limit)[: limit - len(positive)]
    return fit([features(r.piece, r.first, r.alone) for r in own], [r.label for r in own]), aside


def piece_is_residue(weights: np.ndarray, piece: str, first: bool, alone: bool) -> bool:
    return probability(weights, features(piece, first, alone)) >= DECIDED


def are_residue(weights: np.ndarray, texts: list[str | None], judged: dict | None = None) -> list[bool]:
    """Whether some piece of each text is scored as residue; ``judged`` keeps the verdicts on pieces. All new pieces are scored at once."""
    judged = {} if judged is None else judged
    keys = [[(p, i == 0, len(own) <= 2) for i, p in enumerate(own)] for own in map(pieces, texts)]
    fresh = list({k for own in keys for k in own if k not in judged})
    if fresh:
        judged.update(zip(fresh, (probabilities(weights, fresh) >= DECIDED).tolist(), strict=True))
    return [any(judged[k] for k in own) for own in keys]


def residue(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id): the documents that are or contain residue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict = {}
        for batch in batches:
            texts, hit = batch.column(1).to_pylist(), []
            for start in range(0, len(texts), 1000):
                if len(judged) > 100_000:
                    judged.clear()
                hit += are_residue(weights, texts[start : start + 1000], judged)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], names=["doc_id"])

    return spread(documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint").distinct()


def without_residue(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """The clean set: all columns of the documents that are no cases."""
    return documents.join(residue(documents, weights), "doc_id", "left_anti")


def measure(weights: np.ndarray, rows: list, least: float = DECIDED) -> tuple:
    """(pieces, residue, true and false positives, false negatives, precision, recall) of the classifier alone, at a
    probability of ``least``, on labelled pieces."""
    said = (probabilities(weights, [(r.piece, r.first, r.alone) for r in rows]) >= least).tolist() if rows else []
    tp = sum(s and r.label == 1 for s, r in zip(said, rows, strict=True))
    fp, fn = sum(said) - tp, sum(r.label == 1 for r in rows) - tp
    return len(rows), tp + fn, tp, fp, fn, round(tp / max(tp + fp, 1), 4), round(tp / max(tp + fn, 1), 4)
