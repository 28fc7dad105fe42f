"""Records whose text is template residue, filler, an error page or a notice that scripts are needed.

Lines of one template are aligned over the whole corpus: what stays the same is the template's wording, and the places
where its records differ, or keep marked-up names, are slots. A template whose slots keep variable names (two different
ones, one in two documents, or one that stands in other templates too) is unfilled; so is a line of its wording with the
slots left blank, or with a default in them. A byline is a template as well, whose slot holds different people.

Whole-page templates are induced from repetition: a line, or a sentence of a notice, that comes back in documents of
several sources and stands there mostly with nothing but such lines around it, is part of an error page or notice,
whatever its wording. A maxim that comes back as often stands within other text. Wording of notices counts for
sentences that are seen too seldom to tell: nearly all content words of a sentence must be of it, and one of the usual
phrases among them. A record is residue when, after all that and the lines its source repeats excessively
(``linetemplates``) are set aside, no line is left.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm import linetemplates
from siltwork.session import cut

#: Most words of wording around the slots of an unfilled template line; longer ones are sentences about placeholders.
WORDING = 8
#: Most of them where a name is told by the other templates it stands in.
SHORT = 3
#: Different variable names that a template's slots must keep in the corpus, or documents that must keep its only name.
LEAST_NAMES, LEAST_TEXTS = 2, 2
#: Documents and sources in which a part of a whole-page template stands at least, and the share of these documents in
#: which all that is left is of such parts.
PAGE_DOCS, PAGE_SOURCES, PAGE_SHARE = 4, 3, 0.5
#: Least share of the content words of a notice's sentence that are of the wording of notices.
NOTICE_SHARE = 0.75
#: Different people whom the slot of a byline holds at least.
LEAST_PEOPLE = 3

# The ways in which unfilled variables are written.
SLOT = regex.compile(
    r"""
      \{\{\s*[\w.\- ]{1,40}\s*\}\} | \{%\s*[\w.\- ]{1,40}\s*%\} | <%=?\s*[\w.\- ]{1,40}\s*%> | [$\#]\{[\w.\- ]{1,40}\}
    | \{[A-Za-z_][\w.\-]{0,40}\} | \[\[[\w.\- ]{1,40}\]\] | \[(?:INSERT|ENTER|YOUR|ADD)\b[^\]\n]{0,40}\] | %%[A-Za-z_]{1,40}%%
    | %[A-Za-z_]{2,40}% | @@[A-Za-z_]{1,40}@@ | \*\|[A-Za-z_:]{1,40}\|\* | __[A-Z][A-Z_]{0,40}__
    | \[\p{Lu}[\p{L} ]{0,40}\] | <[a-z]+(?:[ _][a-z]+){0,3}> | <<[\w.\- ]{1,40}>> | \#\#[\w.\- ]{1,40}\#\# | ~~?[A-Z_]{2,40}~~?
    | (?<!\w):[a-z]{1,20}(?:_[a-z]{1,20}){1,3}:(?!\w) | \$[A-Z]{2,20}(?:_[A-Z]{1,20}){0,3}\b(?!\s*\d) | \^\^[\w.\- ]{1,40}\^\^
    | (?<![\w'’])(?:undefined|NULL|null|NaN|\[object\ Object\]|TBD|TBA)(?![\w'’])
    """,
    regex.X,
)
#: A line without any of these characters has no slot.
HINT = regex.compile(r"[{%@|<\[_#~:$^]|undefined|NULL|null|NaN|TB[DA]").search
#: What a slot holds that was filled with nothing.
DEFAULTS = frozenset("undefined null nan object_object tbd tba".split())

# Words of the usual Latin dummy text.
LATIN = frozenset(
    """a ac accumsan adipiscing aenean aliqua aliquam aliquet amet ante aptent arcu at auctor augue bibendum blandit
    commodo condimentum congue consectetur consequat convallis cras curabitur cursus dapibus diam dictum dignissim do
    dolor dolore donec dui duis efficitur egestas eget eiusmod eleifend elementum elit enim erat eros est et etiam eu
    euismod ex facilisis faucibus felis fermentum feugiat finibus fringilla fusce gravida habitant hendrerit iaculis id
    imperdiet in incididunt integer interdum ipsum justo labore lacinia lacus laoreet lectus leo libero ligula lobortis
    lorem luctus maecenas magna malesuada massa mattis mauris maximus metus mi molestie mollis morbi nam nec neque nibh
    nisi nisl non nulla nullam nunc odio orci ornare pellentesque pharetra placerat porta porttitor posuere potenti
    praesent pretium proin pulvinar purus quam quis quisque rhoncus risus rutrum sagittis sapien scelerisque sed sem
    semper sit sodales sollicitudin suscipit tellus tempor tempus tincidunt tortor tristique turpis ullamcorper ultrices
    ultricies urna ut varius vehicula vel velit venenatis vestibulum vitae vivamus viverra volutpat vulputate""".split()
)
# Words that stand for nothing: test words, empty values, marks of work to be done.
BLANK = frozenset("foo bar baz qux test tests testing null nan none undefined nil object asdf qwer qwerty xxx tbd tba todo fixme wip n a na blah oops whoops ups hoppla sorry".split())
# Words of a page's navigation.
NAVIGATION = frozenset(
    """menu search home about archive archives letters podcasts contact topics latest help sign in log out login subscribe
    start issue issues next previous back terms privacy faq all posts episodes newsletters shop blog news more top skip to
    content main navigation account startseite suche archiv kontakt impressum hilfe anmelden themen ausgabe über uns accueil
    recherche aide connexion contact thèmes numéros inicio buscar archivo contacto ayuda entrar temas""".split()
)
# Phrases of fillers, error pages, script notices and what stands around them; in lower case.
PHRASES = """
your text goes here|your text here|text goes here|content goes here|replace this paragraph|replace this text|sample paragraph|sample text
placeholder caption|placeholder text|placeholder title|placeholder image|click to edit|body copy to follow|copy to follow|text to follow
dummy content|dummy text|filler text|add a short description|add a description|delete before publishing|for layout only|lorem ipsum
description to come|content coming soon|something went wrong|went wrong on our|enter a title|enter a headline|insert text|enter your text|edit this block|section title
titre de la section|description à venir|votre texte ici|remplacez ce paragraphe|texte à venir|texte de remplissage|texte factice
título de la sección|texto de relleno|escribe aquí tu texto|su texto aquí|tu texto aquí|descripción pendiente|sustituya este párrafo
blindtext|platzhalter|überschrift eingeben|text eingeben|titel eingeben|ihr text hier|hier steht ihr text|text folgt|beschreibung folgt|diesen absatz ersetzen|abschnittstitel|titel des abschnitts
javascript|java script|noscript|scripting|enable scripts|requires scripts|needs scripts|scripts are|your browser|this browser|supported browser
besoin de scripts|les scripts|benötigt skripte|skripte sind|necesita scripts|los scripts|votre navigateur|tu navegador|su navegador|ihrem browser|ihr browser
enable cookies|cookies are
not found|no such item|no such page|access denied|permission denied|forbidden|bad gateway|gateway timeout|gateway time-out|temporarily unavailable
service unavailable|internal server error|server error|fatal error|application error|unexpected error|client-side exception|too many requests
slow down and try again|timed out|no longer exists|could not be loaded|could not be found|cannot be displayed|can't find|can’t find|cannot find|cannot open
has moved|http 410|410 gone|http 404|unauthorized|bad request|url may be|address may be|refresh and try|try again|go back to the home|return to the home
vuelva más tarde|vuelve más tarde|come back later|check back later|revenez plus tard|kommen sie später|en mantenimiento|wartungsarbeiten|en maintenance|problem persists|site owner|nothing else to show|nothing to show|nothing to see|contact the administrator|quota exceeded|upstream failed|feed offline|reference id|error id|under maintenance|under construction
introuvable|accès refusé|accès interdit|erreur interne|erreur du serveur|erreur fatale|une erreur|momentanément indisponible|temporairement indisponible
n'existe plus|n’existe plus|n'existe pas|veuillez réessayer|réessayez|retour à l'accueil|retour à l’accueil|délai dépassé|délai d'attente
nicht gefunden|zugriff verweigert|zugang verweigert|serverfehler|schwerer fehler|ein fehler|nicht erreichbar|gibt es nicht mehr|nicht mehr verfügbar
versuchen sie es|zurück zur startseite|zeitüberschreitung|kennung:
no encontrada|no encontrado|acceso denegado|acceso prohibido|error interno|error del servidor|error fatal|se ha producido un error|no disponible
ya no existe|inténtelo|inténtalo|intente de nuevo|vuelve a intentar|vuelva a intentar|volver al inicio|tiempo de espera|identificador:
{"error"|{"status"|<error |<status
""".replace("\n", "|").strip("|").split("|")

# Content words of error pages, notices and fillers besides those of the phrases, and words without content.
WORDING_OF_NOTICES = """
    access account action address adresse aktivieren aktiviert aktualisieren app application archive article artikel asset attempt availability available
    back bad block body borrar browser button buscar cache capture caption choose clear click client code connection contact content contenu cookies
    couldn crashed dataset deleted denied description detected disabled display document domain edge edit enabled encountered episode episodio épisode
    error erreur error errors exist exists expired failed fallo fatal feed fehler fehlgeschlagen file fix folder forbidden found gateway gone handler
    headline home host http image insert interrupted invalid issue item javascript javaScript kennung keep laden letter letters line link links load loaded loading
    log login logged maintenance mantenimiento message minutes missing mode modo module mode moment moved navegador navigateur network neu node note null number
    object ocurrido old open operation page página pages paragraph path permission permitted please podcast post proxy publishing ray reach reached read reader reading
    recargar recharger record ref reference refresh référence reload removed renamed replaced reported request requested required resource response retry retried return
    route run script scripting scripts search seconds section seite seiten server serveur servicio service session settings shutting site sitio skript skripte
    slow someone sorry source start started state status stopped story stream supported switch system tab téléchargement temporarily terminated text texte texto
    timed timeout title titre titel título tomorrow try turn typed unavailable unexpected unhandled unknown unsupported upgrade upstream url use usual version view visit volver vuelva
    wait web website widget misspelled occurred exception interner interne interno mistyped checking checks accessing comments need needs detected désactivé désactivée desactivado deaktiviert sustituir remplacer ersetzen visiting browsers working write wrong www activar activez activer active actualice activado cargar chargé chargement charger configuración déplacée deshabilitado ajustes réglages paramètres
    einstellungen einschalten schalten eingeschaltet lesen leer lire voir sehen anzeigen ver mostrar afficher fortfahren continuar continuer weiterlesen
    später spater tarde tard más plus moment instant minuten minutes minutos erneut versuchen réessayer intente prüfen vérifier compruebe überprüfen wartung gewartet
    vorübergehend unterbrochen dienst nicht erreichbar gefunden verschoben gelöscht existiert angefragte angeforderte angeforderten gewünschte demandée demandé solicitada solicitado eliminada eliminado movida movido supprimée supprimé
    lettre carta brief ausgabe número edición édition folge zugriff zugang accès acceso anfrage anfragen requête solicitud demasiadas zu viele trop many too
    dieser diese diesen dieses cette ce esta este seite seitenbetreiber wenden administrador administrateur betreiber propriétaire propietario problema problème problem persists weiterhin besteht
""".split()
STOP = frozenset(
    """a an the this that these those of in on at by for to from or and as if it its is are was were be been being has have had do does did will would can could may might must should
    not no you your we our they their there here then so with without into out off up down some any again later now has having who what which when while i my me us just very
    der die das den dem des ein eine einen einem einer und oder zu zum zur von vom im in am an auf für mit ist sind war wird werden wurde haben hat hatte nicht kein keine sie ihr ihre ihrem ihren es bitte um wir uns als auch aus bei nach
    le la les l un une des du de d et ou à au aux en dans pour par sur avec est sont était a ont ne n pas plus vous votre vos nous notre il elle se s ce c que qui y si
    el los las una unos del al y o en para por con es son fue está están se su sus no lo le nos nuestro que si ha han""".split()
)
#: Names of those who wrote or spoke: wording of a template whose only slot is a name.
NAME = r"[\p{Lu}][\p{L}.'’\-]+(?:[  ]+[\p{Lu}][\p{L}.'’\-]*){1,3}"
BYLINE = regex.compile(
    rf"(?i:by|written by|words by|text by|hosted by|edited by|reported by|presented by|produced by|von|ein text von|text von|text|moderation|par|écrit par|un texte de|texte|présenté par|animé par|por|escrito por|un texto de|texto de|presenta|presentado por)[ :]+{NAME}(?:,? .{{0,60}})?"
)
#: A name with what its bearer does, which is a byline if it is said of others too.
TITLED = regex.compile(rf"({NAME}) ?\| ?(\p{{Ll}}[\p{{L}} ]{{2,30}})")
#: Such words written together, several of them or one again and again.
BLANKS = regex.compile(f"(?:{'|'.join(sorted((w for w in BLANK if len(w) > 2 and w != 'xxx'), key=len, reverse=True))}|x{{2,}}+)++")
#: Characters of the longest line that can be a byline.
BYLINE_CHARS = 160
ID = regex.compile(r"\b(?=[0-9a-f\-]*\d)[0-9a-f]{6,40}(?:-[0-9a-f]{1,40})*\b", regex.I)
ADDRESS = regex.compile(r"//|\.[a-z]{2}").search
DIGIT = regex.compile(r"\d").search
HOST = regex.compile(r"(?:https?://\S+|\b[\w\-]{1,63}(?:\.[\w\-]{1,63})*\.[a-z]{2,24}\b)(?=[\s/.,;:!?)]|$)")
SENTENCES = regex.compile(r"(?<=[.!?…])\s+|\s+[|·>•]\s+|\t+|\s{3,}").split
_word = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}'’\-]*")
WORDS, WORD = _word.findall, _word.search


@lru_cache(maxsize=1)
def phrases() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p in filter(None, PHRASES):
        found.add_word(p, len(p))
    found.make_automaton()
    return found


def has_phrase(lower: str) -> bool:
    return next(phrases().iter(lower), None) is not None


@lru_cache(maxsize=1)
def notice_words() -> frozenset[str]:
    return NAVIGATION | BLANK | frozenset(w.lower() for w in WORDING_OF_NOTICES) | frozenset(w for p in PHRASES for w in WORDS(p) if w not in STOP)


def filler(text: str, words: list[str]) -> bool:
    """Is this sentence, of these words, filler, an id, or without any word?"""
    if not words:
        return True
    if words[0] in BLANK or BLANKS.match(words[0]):
        if all(w in BLANK or BLANKS.fullmatch(w) for w in words):
            return True
    if len(words) <= 4 and ID.search(text):
        return True
    return len(words) >= 2 and sum(w in LATIN for w in words) >= 0.8 * len(words)


def notice(words: list[str]) -> bool:
    """Are these, of a sentence with one of the usual phrases, hardly words of anything but an error page or notice?"""
    content = [w for w in words if w not in STOP]
    known = notice_words()
    return bool(content) and sum(w in known for w in content) >= NOTICE_SHARE * len(content)


def words_of(text: str) -> list[str]:
    """Lower-case words, without ids and the names of hosts."""
    return [w.lower() for w in WORDS(ID.sub(" ", HOST.sub(" ", text) if "." in text else text))]


def words_without_ids(text: str) -> list[str]:
    """Lower-case words without ids; most texts hold no digit, without which there is none."""
    return WORDS((ID.sub(" ", text) if DIGIT(text) else text).lower())


def unit_key(text: str) -> int:
    """Key of a part of a page: its letters, ids left out."""
    return linetemplates.line_key("".join(words_of(text)))


def open_sentences(line: str, told: bool) -> list[str]:
    """The sentences of a line that are not filler, nor worded like a notice if ``told``; none if the line is set aside."""
    line = line.strip()
    if told and line[:1] in "{<" and has_phrase(line.lower()):
        return []
    if len(line) <= BYLINE_CHARS and BYLINE.fullmatch(line.strip("*#•–-> ").rstrip(" .!|→…")):
        return []
    start = WORD(line)
    if start and start.group().lower() in NAVIGATION:
        words = WORDS(line)
        if len(words) > 1 and all(w.lower() in NAVIGATION for w in words):
            return []
    if not told:
        # Most lines are told by their first sentence; the others are cut only if that one is set aside.
        first, *rest = SENTENCES(line, 1)
        if first and not filler(first, words_without_ids(first)):
            return [line]
        return [x for x in SENTENCES(rest[0]) if x and not filler(x, words_without_ids(x))] if rest else []
    out = []
    for x in filter(None, SENTENCES(line)):
        words = words_without_ids(x) if ADDRESS(x) is None else words_of(x)
        if not filler(x, words) and not (has_phrase(x.lower()) and notice(words_of(x))):
            out.append(x)
    return out


def template(line: str) -> tuple[str, list[str]]:
    """Wording of a line with its slots cut out, and the variable names the slots keep."""
    names = [m.strip("{}%<>=$#[]@*|_ \t").lower().replace(" ", "_") for m in SLOT.findall(line)]
    return SLOT.sub("\x00", line), names


def skeleton_key(wording: str) -> int:
    text = " ".join(["\x00" if x == "\x00" else x.lower() for x in regex.findall(r"\x00|[\p{L}]+", wording)])
    return (xxhash.xxh64_intdigest("slot " + text) >> 1) or 1


def hashed(text: str) -> int:
    return (xxhash.xxh64_intdigest(text) >> 1) or 1


class Marker:
    """Of a document with a letter: for its lines that wording does not set aside the pairs of line and part, one after
    the other (the part is the line itself, or a sentence of one with notices); and of its templates the quadruples of
    wording, what the slot holds, the kind, and the key of the line."""

    def __call__(self, raw: list[str], own: list[str], keys: list[int]) -> tuple[list[int], list[int]]:
        text = "\n".join(raw)
        hinted = HINT(text) is not None
        told = has_phrase(text.lower())
        marks: dict[tuple[int, int], None] = {}
        slots: list[int] = []
        seen = set()
        for line, letters, key in zip(raw, own, keys, strict=True):
            if not key or key in seen:
                continue
            seen.add(key)
            if hinted and HINT(line):
                wording, names = template(line)
                around = len(WORDS(wording)) if names else 0
                kept = [n for n in names if n not in DEFAULTS]
                if kept and around <= 1 or names and not kept and not open_sentences(line, told):
                    continue
                if names and around <= WORDING:
                    wording_key = skeleton_key(wording)
                    for name in sorted(set(kept)) or sorted(set(names)):
                        slots += [wording_key, hashed(name), DEFAULT_KEPT if not kept else SHORT_KEPT if around <= SHORT else NAME_KEPT, key]
                    # The line as it would be with its slots left blank.
                    slots += [linetemplates.line_key(linetemplates.letters(wording)[0]) or 1, wording_key, BLANK_WORDING, key]
                    continue
            if "|" in line:
                titled = TITLED.fullmatch(line.strip("*#•–-> ").rstrip(" .!|→…")) if len(line) <= BYLINE_CHARS else None
                if titled:
                    slots += [hashed("by " + titled.group(2)), hashed(titled.group(1).lower()), PERSON, key]
                    continue
            for sentence in open_sentences(line, told):
                marks[key, unit_key(sentence) if told or DIGIT(sentence) and ID.search(sentence) else key] = None
        return [k for pair in marks for k in pair], slots


NAME_KEPT, SHORT_KEPT, DEFAULT_KEPT, PERSON, BLANK_WORDING = range(5)


def page_parts(units: DataFrame) -> DataFrame:
    """(unit) of the parts of whole-page templates; ``units`` has doc_id, source, unit and explained, whether the
    document's source repeats the line anyway.

    Counts are of all documents and add up before they are shuffled; a part that a third of all documents holds is one
    row of them.
    """
    open_ = units.where(~F.col("explained"))
    by_source = open_.groupBy("unit", "source").agg(F.count(F.lit(1)).alias("n"))
    often = by_source.groupBy("unit").agg(F.sum("n").alias("docs"), F.count("source").alias("sources")).where((F.col("docs") >= PAGE_DOCS) & (F.col("sources") >= PAGE_SOURCES))
    often = cut(often.select("unit", "docs"), "often")
    # Documents of which all is left that comes back.
    held = open_.join(often.select("unit", F.lit(1).alias("again")), "unit", "left")
    whole = held.groupBy("doc_id").agg(F.count_if(F.col("again").isNull()).alias("other")).where("other = 0").select("doc_id")
    inside = open_.join(often, "unit").join(whole, "doc_id", "left_semi").groupBy("unit").agg(F.count(F.lit(1)).alias("alone"), F.first("docs").alias("docs"))
    return inside.where(F.col("alone") >= PAGE_SHARE * F.col("docs")).select("unit")


def residue(docs: DataFrame, artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id) of the documents with text of which nothing is left as real content.

    Documents need doc_id, text, source, artifact_hash. A null, empty or blank text and one without a single letter is
    no case; a document without any source has only its own lines to explain it; a document given twice is found twice;
    empty tables give an empty result; other columns are ignored.
    """
    fallback = cut(linetemplates.fallback_sources(docs, artifacts, manifest), "sources")
    scanned = cut(linetemplates.scan(docs, Marker), "lines")
    bad = cut(linetemplates.excessive(scanned, fallback, linetemplates.totals(docs, fallback)), "excessive")
    rows = cut(linetemplates.resolve(scanned.where("marks is not null").select("source", "hash", "doc_id", "marks", "slots"), fallback), "marked")

    # Templates: wording, what its slots hold, and the lines that are of it.
    each = F.expr("transform(sequence(0, size(slots) div 4 - 1), i -> struct(slots[4 * i] as wording, slots[4 * i + 1] as name, slots[4 * i + 2] as kind, slots[4 * i + 3] as line))")
    held = cut(rows.where(F.size("slots") > 0).select("doc_id", F.explode(each).alias("p")).select("doc_id", "p.*"), "slots")
    names = held.where(F.col("kind").isin(NAME_KEPT, SHORT_KEPT))
    common = names.groupBy("name").agg(F.count_distinct("wording").alias("n")).where("n >= 2").select("name")
    elsewhere = names.where(F.col("kind") == SHORT_KEPT).join(common, "name", "left_semi").select("wording").distinct()
    varied = names.groupBy("wording").agg(F.count_distinct("name").alias("names"), F.count_distinct("doc_id").alias("texts"))
    unfilled = cut(varied.where((F.col("names") >= LEAST_NAMES) | (F.col("texts") >= LEAST_TEXTS)).select("wording").union(elsewhere).distinct(), "templates")
    people = held.where(F.col("kind") == PERSON).groupBy("wording").agg(F.count_distinct("name").alias("n")).where(F.col("n") >= LEAST_PEOPLE).select("wording")
    blank = held.where(F.col("kind") == BLANK_WORDING).select(F.col("wording").alias("line"), F.col("name").alias("wording")).join(unfilled, "wording", "left_semi").select("line").distinct()
    known = unfilled.union(people)
    # A line of a template that is not known to be one is left.
    own_lines = held.where(F.col("kind") != BLANK_WORDING).join(known, "wording", "left_anti").select("doc_id", "line")

    pairs = F.expr("transform(sequence(0, size(marks) div 2 - 1), i -> struct(marks[2 * i] as line, marks[2 * i + 1] as unit))")
    marked = rows.where(F.size("marks") > 0).select("doc_id", "source", F.explode(pairs).alias("p")).select("doc_id", "source", "p.line", "p.unit")
    marked = marked.unionByName(own_lines.join(rows.select("doc_id", "source"), "doc_id").select("doc_id", "source", "line", F.col("line").alias("unit")).distinct())
    explained = bad.select("source", F.col("key").alias("line"), F.lit(True).alias("is_bad"))
    units = marked.join(explained, ["source", "line"], "left").join(blank.select("line", F.lit(True).alias("is_blank")), "line", "left")
    units = cut(units.select("doc_id", "source", "unit", (F.col("is_bad").isNotNull() | F.col("is_blank").isNotNull()).alias("explained")), "units")
    parts = page_parts(units)
    real = units.where(~F.col("explained")).join(parts, "unit", "left_anti").select("doc_id").distinct()
    return rows.select("doc_id").join(real, "doc_id", "left_anti")


def without_residue(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that are not residue; rows with a null doc_id are kept."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
