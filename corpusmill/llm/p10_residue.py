"""Problem 10: template residue, filler, error output and script notices in place of content.

Lines are normalised (numbers and codes masked, punctuation and spacing folded) and counted by
source; lines that many documents of one source share are its boilerplate and are taken off where
any other line remains.  The whole text and the residual are judged, and either makes a case: a
placeholder that stands for a value or word, or evidence of filler, an error or a script notice that
makes up most of it.

Evidence is graded.  Single words weigh little: what failed, what is missing and how the reader is
addressed are weights of words in several languages, which add up over a sentence and over the
different words of the text, whatever the wording and the length.  A text that only speaks of such
things reaches neither measure.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from .common import Durable, arrow_map, flat, fold, join_unique, words

#: A line is boilerplate of its source if this share of its documents hold it, and so many at least
#: that it is no coincidence.
RECURRENT_SHARE, RECURRENT = 0.01, 10
#: Share of the words that stand in sentences with evidence, or weight of the different words by
#: their number: either makes a case.
SHARE, DENSITY = 0.5, 0.15
#: Weight that the different words of a case have at least, less of it where they are dense, and its
#: sentences with evidence.
TOTAL, LESS, DENSE, SENTENCE = 2.0, 1.5, 0.2, 1.0
#: Words for which a sentence needs the weight SENTENCE; longer ones need more.
SENTENCE_WORDS = 12
#: Words over which a sentence that goes on over lines is read line by line.
RUN_ON = 40
#: Recurrent line keys (8 bytes each) that may be sent to every task; above, they join by shuffle.
BROADCAST_KEYS = 1 << 20
#: A word belongs to the filler lexicon if it makes up this share of the words of known filler: at
#: most one in so many words can, so the lexicon is bounded however much filler there is.
LEXICON_SHARE = 1e-5

# The forms of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{\s*[^\W\d][\w.\- ]{1,40}?\s*\}\}|[$#]\{\s*[^\W\d][\w.]{1,40}\s*\}|<%=?\s*[^\W\d][\w.]{1,40}\s*%>|\{%\s*[^\W\d][\w. ]{1,40}?\s*%\}"
    r"|%\([^\W\d][\w.]{1,40}\)[sdf]|\[\[\s*[^\W\d][\w.]{1,40}\s*\]\]|<<\s*[^\W\d][\w.]{1,40}\s*>>"
    r"|(?i:\[(?:insert|your|add|enter|insérer|einfügen|insertar|inserire|inserir)\s[\w. ]{1,40}\]|\[[\w.]{1,40} (?:goes )?here\]|\[[\w.]{1,40} (?:ici|hier|aquí)\])"
    r"|\b__[^\W\d_][\w.]{1,40}?__\b|\b(?:XX_[\w.]{1,40}?_XX|xx_[\w.]{1,40}?_xx|Xx_[\w.]{1,40}?_Xx)\b|(?<![\w$#{%\"'])\{[^\W\d][\w.]{2,40}\}(?!\})"
    r"|<[A-Z][A-Z_ ]{2,30}>(?![^\n]*</)|(?<![\w-])X{3,}(?![\w-])|(?<![\w-])(?:TBD|TBA|TBC)(?![\w-])"
)
_OPENERS = ("{", "[", "<", "__", "%(", "XX", "xx_", "Xx_", "TB")
# Words by which a sentence shows that it speaks about placeholders.
SPEAKS = frozenset(
    "brace braces bracket brackets template templates placeholder placeholders variable variables shell syntax marker markers escaped literally"
    " klammer klammern vorlage vorlagen platzhalter platzhaltern accolade accolades gabarit gabarits balise balises llave llaves plantilla plantillas marcador marcadores".split()
)


def _weights(text: str, weight: float) -> dict[str, float]:
    return dict.fromkeys(text.split(), weight)


# Words that report a failure, by weight.
ERROR = {
    **_weights("error errors erreur erreurs fehler errore errori erro exception traceback undefined unhandled fatal nan segfault"
               " forbidden denied authorised authorized unauthorized unauthorised unavailable offline expired timeout unexpected wrong invalid maintenance overloaded reload oops snag"
               " interdit interdite refusé refusée introuvable indisponible expiré expirée"
               " verweigert gesperrt nichterreichbar abgelaufen wartung wartungsarbeiten wartungsarbeit"
               " prohibido prohibida denegado denegada expirado expirada caducado caducada mantenimiento"
               " negato vietato trovata trovato scaduta scaduto manutenzione encontrada negado proibido expirou manutenção indisponível", 1.0),
    **_weights("found permission locate find unable encountered misconfiguration removed moved exist exists deleted gone longer unknown failed failure failures fault occurred timed"
               " broken crashed crash blocked block refused rejected retry denies lack closed down busy slow many requests"
               " variable object argument null segmentation stack trace upstream origin gateway database connection"
               " existe disponible supprimé supprimée déplacé déplacée survenu survenue impossible charger réessayer réessayez autorisé"
               " gefunden erreichbar verfügbar existiert erneut versuchen zutritt zugriff unbekannt gelöscht überlastet störung"
               " encontrado ocurrió produjo servicio inténtelo intente intentar intentarlo vuelva eliminado eliminada"
               " esiste riprova riprovare accesso tente novamente acesso ocorreu removida rimossa"
               " nothing answer answered cannot too", 0.5),
}
# Words that ask for scripts, by weight.
SCRIPT = {
    **_weights("noscript javascript javascripts ecmascript scripting js", 1.0),
    **_weights("script scripts skript skripte skripten verifying checking browser navigateur navegador browsers enable enabled activate disabled required requires"
               " activer activez autoriser autorisez désactivé désactivés bloqué bloqués masqué aktivieren aktiviert erlauben deaktiviert blockiert"
               " habilite habilitar active activar activos bloquea bloqueados abilitare attivare abilita attiva disabilitato ative ativar", 0.5),
}
# Words that filler says of itself, by weight.
FILLER = {
    **_weights("lorem ipsum dummy publishing placeholder blindtext beispieltext platzhaltertext fülltext relleno segnaposto", 1.0),
    **_weights("blindtext beispieltext platzhaltertext fülltext", 1.5),
    **_weights("sample content text copy paragraph title goes comes appear filled added announced replace coming soon here"
               " ici texte exemple venir aquí va texto ejemplo hier steht inhalt testo qui aqui conteúdo", 0.5),
}
# Words by which a system names itself or addresses its reader; they only add to the others.
READER = _weights(
    "page site server service system address resource document record entry archive link url session token login network access request app"
    " you your please sorry wait waiting moment thanks try something"
    " seite dienst sitzung ihr ihre ihrer bitte serveur ressource adresse accès votre vos veuillez"
    " página servidor recurso dirección acceso sesión servicio su sus pagina risorsa indirizzo richiesta endereço sistema", 0.5
)
ADDRESS = READER | _weights(
    "again later back come check ask owner contact turn need needs allow allowed see view shown continue side saved sign looking not planned line"
    " später zurück anzeigen weiter kein keine keinen nicht inhalt leer verborgen momento content key plus tard afficher continuer contenu cette été revenir"
    " su sus tarde más continuar contenido muestra fuera tua sua tardi mais não non", 0.5
)
# Words of a sentence that speaks about messages instead of being one.
ABOUT = frozenset("message messages notice notices wording phrase means explains says called reads wrote meldung meldungen hinweis hinweise mensaje mensajes aviso avisos avis".split())
_KINDS = {"error": ERROR, "script": SCRIPT, "filler": FILLER}
_CORE = {w: v for kind in _KINDS.values() for w, v in kind.items()}
_POINTS = {**ADDRESS, **{w: max(v, ADDRESS.get(w, 0)) for w, v in _CORE.items()}}
_CORE_WORDS = frozenset(_CORE)
_CUES = frozenset(_POINTS)
_NONE = itertools.repeat(0.0)
# A code or a number with its usual label, which says nothing of a text.
_LABEL = re.compile(r"\b(?:request id|incident|ref\.?|id)\s*(?=[#\w-]*\d)", re.I)
_CODE = re.compile(r"[\w/.-]*\d[\w/.-]*")
#: Numbers that may be the status of a response, and where in a sentence they are one.
_STATUSES = frozenset(map(str, [*range(400, 432), 451, *range(500, 512)]))
_STATUS = re.compile(r"(?:(?:\A|\n)\W*|\b(?:http|error|erreur|fehler|errore|erro|status)\W{0,3})[45]\d\d(?!\w|[.,:;]?\d|\t|[,;]\w)", re.I)
_KEYED = re.compile(r"[^\W_]+(?:[-_]+[^\W_]+)*")
_MASK = (1 << 64) - 1
_DIGIT = re.compile(r"\d")
_FRAME = re.compile(r"\s*(?:at \S+\(|at \S+ \(\S+:\d+\)|File \"|#\d+ )")
_INDENT = re.compile(r"[^\S\n]*")
# The line of an error's name and message in error output.
_RAISED = re.compile(r"\s*(?:(?i:caused by: )|Exception in thread \S+ )?(?:[\w.$]*(?:Error|Exception)|[\w.$]+(?:Interrupt|Exit))\b\s*(?::|\Z)")
_RAISING = ("Error", "Exception", "Interrupt", "Exit")
# A line of a log, which reports errors among other things.
_LOG = re.compile(r"^\W*\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*\b(?:INFO|DEBUG|WARN|TRACE|ERROR)\b", re.M | re.I)
_TERMINAL = re.compile(r"[.!?…:;][\"'”»)\]]*\s*\Z")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n\s*\n")


def line_keys(folded: str, host: int, spaced: str | None = None) -> list[int]:
    """A 64-bit key of each line of a folded text: its source and its words, with numbers and codes masked; 0 without letters.

    ``spaced`` is ``flat(folded)``, where the caller has it.
    """
    import xxhash

    out = []
    for line, plain in zip(folded.split("\n"), (flat(folded) if spaced is None else spaced).split("\n")):
        if _DIGIT.search(line):
            masked = ["0" if _DIGIT.search(x) else x for x in _KEYED.findall(line)]
            # As many numbers in a row as there are: one.
            found = " ".join(x for k, x in enumerate(masked) if x != "0" or not k or masked[k - 1] != "0")
            found = " ".join(flat(found).split())
            if found == "0":
                found = ""
        else:
            found = " ".join(plain.split())
        out.append((xxhash.xxh3_64_intdigest(found.encode("utf-8", "replace"), host & _MASK) - (1 << 63) or 1) if found else 0)
    return out


def filler_lexicon(docs: DataFrame, common: set[str], share: float = LEXICON_SHARE) -> set[str]:
    """Words that stand with the classic filler words in sentences without any common word.

    A word needs two places and ``share`` of all, so there are at most 1 / share words.
    """

    def each(batch):
        out: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for s in _SENTENCE.split(text.replace("\n", " ")):
                w = words(s)
                if len(w) >= 4 and ("lorem" in w or "ipsum" in w) and not common.intersection(w):
                    out.update(x for x in w if x.isalpha())
        return {"word": list(out), "n": list(out.values())}

    seeds = docs.select("text").where(F.lower("text").contains("lorem") | F.lower("text").contains("ipsum"))
    counted = arrow_map(seeds, each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = Durable(docs.sparkSession).keep(counted, "lexicon")
    floor = max(2.0, share * (counted.agg(F.sum("n")).first()[0] or 0))
    return {r.word for r in counted.where(F.col("n") >= floor).toLocalIterator()} | {"lorem", "ipsum"}


def residual(text: str, boilerplate) -> str:
    """The text without its source's boilerplate lines, where any other line has words."""
    if boilerplate is None or not len(boilerplate):
        return text
    lines = text.split("\n")
    left = "\n".join(line for line, off in zip(lines, boilerplate) if not off)
    return left if len(left) < len(text) and words(left) else text


def verdict(text: str | None, lexicon: frozenset[str] | set[str] = frozenset(("lorem", "ipsum")), w: list[str] | None = None) -> str | None:
    """placeholder, filler, error, script, or None; of a whole or residual text.

    Placeholders count wherever they stand: an unfilled template recurs by nature, so the whole text
    is always searched for them.  ``w`` are the words of the text, where the caller has them.
    """
    if not text or text.isspace():
        return None
    if any(c in text for c in _OPENERS) and PLACEHOLDER.search(text):
        for s in _SENTENCE.split(text.replace("\r", "")):
            if PLACEHOLDER.search(s) and SPEAKS.isdisjoint(words(s)):
                return "placeholder"
    if w is None:
        w = words(text)
    different = set(w)
    if not lexicon.isdisjoint(different) and sum(map(lexicon.__contains__, w)) >= SHARE * len(w) > 1:
        return "filler"
    points = _points(different)
    if not _STATUSES.isdisjoint(different) and _STATUS.search(text):
        points += LESS
    if points >= LESS:
        title = text.count(" ", 0, text.find("\n")) + 1 if "\n" in text else 0
        least = len(different) - title
        if points >= DENSITY * least or points + sum(map(_POINTS.get, w, _NONE)) >= least * SHARE / SENTENCE_WORDS:
            return _graded(text)
    if any(x in text for x in _RAISING):
        return _graded(text)
    return None


def _units(text: str):
    """(text, whether it names an error) of the parts of a text.

    Stack frames, with the deeper source lines after them, say nothing of their own and are left out.
    The line that names an error is a part; of the rest each sentence, by lines where it goes on
    without an end over many words.
    """
    run: list[str] = []
    frame = None
    for line in text.split("\n"):
        indent = _INDENT.match(line).end()
        if _FRAME.match(line):
            frame, named = indent, False
        elif frame is not None and indent > frame and line.strip():
            continue
        else:
            frame, named = None, bool(_RAISED.match(line))
            if not named:
                run.append(line)
                continue
        yield from ((s, False) for s in _sentences(run))
        run = []
        if named:
            yield line, True
    yield from ((s, False) for s in _sentences(run))


def _sentences(run: list[str]):
    for s in _SENTENCE.split("\n".join(run)):
        if "\n" in s and s.count(" ") + s.count("\n") >= RUN_ON:
            yield from s.split("\n")
        else:
            yield s


def _points(w: set[str]) -> float:
    """The weight of different words, if any of them reports anything."""
    return 0.0 if w.isdisjoint(_CORE_WORDS) else sum(map(_POINTS.__getitem__, w & _CUES))


def _graded(text: str) -> str | None:
    """error, script, filler, or None, by the weights of the words; each different part counts once.

    Numbers and codes do not count as words, nor does a title.
    """
    head, _, rest = text.strip().partition("\n")
    if not _TERMINAL.search(head) and not _RAISED.match(head) and not _points(set(words(head))) and not _STATUS.search(head) and words(_bare(rest)):
        text = rest
    size = covered = 0
    named_words = 0
    bag: set[str] = set()
    seen: set[tuple] = set()
    speaks = status = 0
    for s, named in _units(text):
        w = words(s)
        key = tuple(x for x in (words(_bare(s)) if _DIGIT.search(s) else w))
        if key in seen or not w:
            continue
        seen.add(key)
        size += len(key)
        different = set(w)
        bag |= different
        points = _points(different)
        if not _STATUSES.isdisjoint(different) and _STATUS.search(s):
            # A status reports by itself; what stands beside it says what failed.
            points = 1.0 + (points or sum(map(_POINTS.__getitem__, different & _CUES)))
            status += 1
        if not ABOUT.isdisjoint(different):
            speaks += points > 0
            points -= SENTENCE
        if named or points >= SENTENCE * max(1.0, len(key) / SENTENCE_WORDS):
            covered += len(key)
            named_words += named
    core = bag & _CORE_WORDS
    if named_words:
        return "error" if covered >= SHARE * size and not _LOG.search(text) else None
    total = (sum(map(_POINTS.__getitem__, bag & _CUES)) + 1.0 if status else _points(bag)) - speaks * SENTENCE
    density = total / max(1, sum(map(str.isalpha, bag)))
    if total < (LESS if density >= DENSE else TOTAL) or covered < SHARE * size and density < DENSITY or _LOG.search(text):
        return None
    # Weak words alone report nothing unless they address a reader or are almost all there is.
    if not status and density < 2 * DENSE and bag.isdisjoint(READER) and max(map(_CORE.__getitem__, core), default=0) < 1:
        return None
    by = {kind: sum(map(of.__getitem__, core & of.keys())) for kind, of in _KINDS.items()}
    return max(by, key=by.get)


def _bare(text: str) -> str:
    return _CODE.sub(" ", _LABEL.sub(" ", text))


# --- over documents --------------------------------------------------------------------------

_SCANNED = "h long, key long, n long, doc_id long, kind string, text string"


def scan(docs: DataFrame, work: Durable, each_text=None, name: str = "scan") -> DataFrame:
    """One pass over the texts, written down: how many documents of a host (``h``) hold a line (``key``).

    Lines are counted once a document and pre-aggregated, so a line that every page of a source
    repeats is one row a batch; key 0 counts the documents with text.  ``each_text(text, folded,
    flat)`` may return (kind, text or None), which adds a row with the doc_id.
    """

    def each(batch):
        n: Counter = Counter()
        rows = []
        for i, text, h in zip(*(c.to_pylist() for c in batch.columns)):
            folded = fold(text)
            spaced = flat(folded)
            keys = set(line_keys(folded, h, spaced))
            keys.add(0)
            n.update((h, key) for key in keys)
            if each_text and i is not None and (got := each_text(text, folded, spaced)):
                rows.append((i, *got, h))
        none = [None] * len(rows)
        return {
            "h": [h for h, _ in n] + [r[3] for r in rows], "key": [key for _, key in n] + none, "n": list(n.values()) + none,
            "doc_id": [None] * len(n) + [r[0] for r in rows], "kind": [None] * len(n) + [r[1] for r in rows], "text": [None] * len(n) + [r[2] for r in rows],
        }

    return work.keep(arrow_map(_hosted(docs), each, _SCANNED), name)


def _hosted(docs: DataFrame) -> DataFrame:
    return docs.where(F.length("text") > 0).select("doc_id", "text", F.xxhash64("host").alias("h"))


def recurrent(scanned: DataFrame, work: Durable, least: int = RECURRENT, share: float = RECURRENT_SHARE) -> DataFrame:
    """(h, key, n) of the lines that ``share`` of the documents of one source hold, ``least`` of them at least."""
    counted = scanned.where("key is not null").groupBy("h", "key").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("key") == 0))
    counted = work.keep(counted, "counted")
    held = counted.where("key <> 0")
    sizes = held.groupBy("h").agg(F.count("*").alias("weight")).join(counted.where("key = 0").select("h", F.col("n").alias("docs")), "h")
    met = join_unique(held, sizes, "h", "weight")
    return work.keep(met.where(F.col("n") >= share * F.col("docs")).select("h", "key", "n"), "recurrent")


def recurrent_lines(docs: DataFrame, least: int = RECURRENT, share: float = RECURRENT_SHARE) -> DataFrame:
    """(h, key, n) of the recurrent lines of ``docs`` with text and host; null and empty texts do not count."""
    work = Durable(docs.sparkSession)
    return recurrent(scan(docs, work), work, least, share)


_KNOWN: dict[str, dict[int, frozenset[int]]] = {}


def _known(shared) -> dict[int, frozenset[int]]:
    """Recurrent keys by host, laid out once a worker."""
    if shared.id not in _KNOWN:
        h, keys = shared.value
        by: dict[int, list[int]] = {}
        for a, b in zip(h.tolist(), keys.tolist()):
            by.setdefault(a, []).append(b)
        _KNOWN.clear()
        _KNOWN[shared.id] = {a: frozenset(b) for a, b in by.items()}
    return _KNOWN[shared.id]


class _Shared:
    """A broadcast with a name by which a worker knows it again."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def residual_kinds(base: DataFrame, lines: DataFrame, lexicon: set[str], broadcast_keys: int = BROADCAST_KEYS) -> DataFrame | None:
    """(doc_id, kind) of the documents whose residual is a case; of sources without recurrent lines none.

    ``base`` has doc_id, text and h.  Recurrent keys go to the tasks while they are few, else the
    lines meet them by shuffle, hot lines dealt over several tasks.  None where no line recurs.
    """
    many = lines.agg(F.count("*")).first()[0]
    if not many:
        return None
    base = base.where("doc_id is not null")
    if many <= broadcast_keys:
        got = lines.select("h", "key").toArrow()
        shared = _Shared(base.sparkSession.sparkContext.broadcast((got.column(0).to_numpy(), got.column(1).to_numpy())))
        base = base.join(F.broadcast(lines.select("h").distinct()), "h", "left_semi").select("doc_id", "text", "h")

        def flags(text, h):
            known = _known(shared)[h]
            return [key in known for key in line_keys(fold(text), h)]
    else:

        def at(batch):
            rows = [(i, k, key) for i, text, h in zip(*(c.to_pylist() for c in batch.columns)) for k, key in enumerate(line_keys(fold(text), h)) if key]
            return {"doc_id": [r[0] for r in rows], "at": [r[1] for r in rows], "key": [r[2] for r in rows]}

        # The host is part of what a key is made of.
        exploded = arrow_map(base.select("doc_id", "text", "h"), at, "doc_id long, at int, key long")
        hit = join_unique(exploded, lines.groupBy("key").agg(F.sum("n").alias("weight")), "key", "weight").groupBy("doc_id").agg(F.collect_set("at").alias("h"))
        base = base.drop("h").join(hit, "doc_id").select("doc_id", "text", "h")

        def flags(text, found):
            known = frozenset(found)
            return [k in known for k in range(text.count("\n") + 1)]

    def each(batch):
        out: dict[str, list] = {"doc_id": [], "kind": []}
        for i, text, h in zip(*(c.to_pylist() for c in batch.columns)):
            left = residual(text, flags(text, h))
            kind = verdict(left, lexicon) if left is not text else None
            if kind:
                out["doc_id"].append(i), out["kind"].append(kind)
        return out

    return arrow_map(base, each, "doc_id long, kind string")


def residue(docs: DataFrame, common: set[str], least: int = RECURRENT, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, kind) of the documents to leave out.

    ``docs`` has doc_id, text and host (null hosts are one host).  Null, empty and blank texts are
    no cases; an empty table gives no rows; further columns are ignored.
    """
    work = Durable(docs.sparkSession)
    lexicon = filler_lexicon(docs, common)

    def each_text(text, folded, spaced):
        kind = verdict(text, lexicon, spaced.split())
        return (kind, None) if kind else None

    scanned = scan(docs, work, each_text)
    whole = scanned.where("doc_id is not null").select("doc_id", "kind")
    more = residual_kinds(_hosted(docs), recurrent(scanned, work, least), lexicon, broadcast_keys)
    if more is None:
        return whole
    both = whole.withColumn("turn", F.lit(0)).unionByName(more.withColumn("turn", F.lit(1)))
    return both.groupBy("doc_id").agg(F.min_by("kind", "turn").alias("kind"))
