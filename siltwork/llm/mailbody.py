"""What the sender of a mail newly wrote, apart from quoted history, signatures, disclaimers and notices.

A body is cut into lines with their quote depth (prefixes and HTML containers), the lines into blocks: paragraphs that
are cut again where the layout changes, as at an introducing line, a closing formula or a name. Each block becomes a
vector of contact density, quote depth, place and wording, of how often the sender, any sender and the thread repeat
its lines in the corpus, and is classified by gradient-boosted trees. No label is given by hand: a block is not
new where two views that know nothing of each other agree, what the layout makes of it and whether other mails hold its
lines or its marks show that they are from one (a quotation, a footer or a signature comes back), and new where a
layout without doubt says so. The verdict of the layout is no feature; blocks that it alone would set aside, and those
it is in doubt of, are left to the trees. They are fitted on a bounded sample of labelled blocks; the rest of the work
covers every mail.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.session import cut

#: Most labelled blocks the trees are fitted on, chosen by a hash of their mail.
SAMPLE = 12_000
#: Trees, their depth and the seed of their fit.
TREES, DEPTH, SEED = 20, 5, 7
#: Lines that come back less often than this in a scope are not looked up.
LEAST = 2

# Field names of a message header, verbs of an introducing line, closing formulas, greetings, footers of
# devices, wording of disclaimers and of notices by mail systems and lists; English, German, French, Spanish.
FIELDS = r"from|sent|to|cc|bcc|subject|date|reply-to|von|gesendet|an|betreff|datum|kopie|de|envoyé|à|objet|enviado|para|asunto|fecha"
FIELD = regex.compile(rf"\*?(?:{FIELDS})\s?:\*?(?:\s|$)", regex.I)
AUTHOR_FIELD = regex.compile(r"\*?(?:from|von|de)\s?:\*?\s*(.+)", regex.I)
DIVIDER = regex.compile(
    r"-{2,}\s*(?:original message|forwarded message|forwarded by.*|message d.origine|message original|message transféré|ursprüngliche nachricht|weitergeleitete nachricht|mensaje original|mensaje reenviado)\s*-{2,}|(?:begin forwarded message|début du message (?:transféré|réexpédié)|anfang der weitergeleiteten (?:nachricht|e-mail)|inicio del mensaje reenviado)\s?:",
    regex.I,
)
INTRO = regex.compile(
    r"(?:on|at|am|le|el|il|em|op|den|vom)\b.*\d.*\b(?:wrote|writes|said|schrieb|écrit|escribió|dijo|scritto|escreveu|schreef|skrev)\b.*:|.{2,120}(?:\b(?:wrote|writes|said|schrieb|a écrit|escribió|ha scritto|escreveu|schreef|skrev)\b)[^.!?]{0,60}(?:\(?\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\)?)?\s?:",
    regex.I,
)
#: An introducing line is no longer than this.
INTRO_CHARS = 400
STARTS = regex.compile(r"(?:on|at|am|le|el|il|em|op|den|vom)\b.*\d", regex.I)
VERB = regex.compile(r"\b(?:wrote|writes|said|schrieb|écrit|escribió|dijo|scritto|escreveu|schreef|skrev)\b", regex.I)
CLOSING = regex.compile(
    r"(?:best|kind|warm|kindest|warmest|with best|with kind)?\s?(?:regards|wishes)|best|many thanks|thanks(?: again| a lot| so much)?|thank you|cheers|talk soon|speak soon|see you soon|sincerely|yours(?: sincerely| truly| faithfully)?|all the best|take care"
    r"|mit (?:freundlichen|besten|herzlichen|lieben) grüßen|(?:viele|beste|liebe|herzliche|schöne|freundliche) grüße|grüße|(?:lieben |besten |schönen )?gruß|danke|vielen dank|bis bald"
    r"|(?:bien )?cordialement|bien à (?:vous|toi)|à bientôt|merci(?: beaucoup| d'avance)?|amicalement|(?:meilleures |sincères )?salutations|bonne journée"
    r"|(?:un )?(?:cordial |afectuoso )?saludos?(?: cordiales)?|(?:muchas )?gracias|atentamente|un abrazo|hasta pronto",
    regex.I,
)
POSTSCRIPT = regex.compile(r"(?:p\.?[ -]?s\.?|p\.?[ -]?d\.?|n\.?\s?b\.?|post-?scriptum|nachtrag|posdata)\s?[:.]|(?:ps|pd|nb)\b\s?[:.–-]|(?:oh,? and|one more thing|one last thing|by the way|btw|ach ja|übrigens|noch (?:etwas|eins|was)|au fait|encore une chose|une dernière chose|ah,? et|por cierto|una cosa más|ah,? y|otra cosa)\s?[:,–-]", regex.I)
GREETING = regex.compile(
    r"(?:hi|hello|hey|dear|good (?:morning|afternoon|evening)|hallo|liebe[rs]?|guten (?:tag|morgen|abend)|moin|bonjour|bonsoir|salut|chère?s?|hola|buen[oa]s (?:días|tardes|noches)|estimad[oa]s?|querid[oa]s?)\b[\s,]*(.{0,60}?)\s*[,:;!–—-]?",
    regex.I,
)
DEVICE = regex.compile(
    r"sent from my\b[^.;]{0,60}[.!]?|sent (?:via|with|from)\b[^,.;]{0,40}[.!]?|get (?:the )?.{0,40}\b(?:app|mail)\b.*|(?:von|mit) meine[mr] .{0,40}(?:gesendet|geschickt).*|gesendet (?:von|mit)\b.*|envoyé (?:de|depuis|avec|à partir de)\b.*|enviado (?:desde|con)\b.*",
    regex.I,
)
DISCLAIMER = regex.compile(
    r"named recipient|intended recipient|privileged|do not (?:copy|forward|disclose)|(?:got|received) this (?:by mistake|in error)|delete it and tell|views here are|do not bind|registered office|company no|may read and store mail|for compliance|forms a contract|contract unless|before printing|think of the (?:trees|environment)"
    r"|nur für den empfänger|vertraulich und|irrtümlich|löschen sie|sitz der gesellschaft|\bhrb\b|geschäftsführer|bindet .{0,40} nicht|keine verpflichtung|verpflichtet .{0,30} nicht"
    r"|confidentiel et|réservé à son destinataire|en cas d.erreur|prévenir l.expéditeur|n.est pas engagée?|siège social|\brcs\b|avant d.imprimer"
    r"|confidencial y|solo a su destinatario|por error, bórrelo|avise al remitente|no asume obligaciones|domicilio social|\bcif\b|antes de imprimir",
)
NOTICE = regex.compile(
    r"\[?external\]?(?: e?mail)?\b.{0,120}(?:outside|links|sender)|^\[external\]|^caution\b|sender not verified|came from outside|careful with links|scanned (?:for|by)\b|checked for (?:viruses|threats)|virus[- ]free|mailing list|leave this list|unsubscribe|you get this because|reply above this line|list-?(?:info|archive)|manage your (?:subscription|preferences)"
    r"|externe e-?mail|absender nicht|auf viren|verteiler|abmelden|expéditeur (?:externe|non vérifié)|courriel externe|liste de diffusion|désabonner|désinscri|correo externo|remitente no verificado|lista de correo|darse de baja",
)
EMAIL = regex.compile(r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,9}")
CONTACT = regex.compile(r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,63}\.[\w-]|https?://\S+|www\.\S+|☎|(?:\b(?:t|tel|phone|fax|mobile|mob|m|f)\b\.?:?\s*)?\+?\d[\d\s()/-]{5,}\d|^\d{1,4} [\p{Lu}][\p{L}]+ [\p{L}]+,", regex.I)
SEPARATOR = regex.compile(r"(?:[-_=*~#–—]\s?){1,}")
PREFIX = regex.compile(r"\s{0,3}(?:[>|]\s{0,2})+")
TAG = regex.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<!--.*?-->")
QUOTE_BOX = regex.compile(r"class\s*=\s*[\"'][^\"']*(?:quote|cite|history|reply)|border-left|type\s*=\s*[\"']?cite", regex.I)
SIGNATURE_BOX = regex.compile(r"class\s*=\s*[\"'][^\"']*(?:signature|sig\b|disclaimer|footer)|color\s*:\s*(?:#(?:888|999|777|aaa|666)|gr[ae]y)[^\"']*font-size|font-size\s*:\s*(?:[5-9]|0\.\d)", regex.I)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
SENTENCE_END = regex.compile(r"[.!?…][”\"»)]?$").search
STOP = regex.compile(r"[.!?:][”\"»]?$").search
CALLED = regex.compile(r"(\p{Lu}\p{L}+)\s?[,:–—-]").fullmatch
REACHED = regex.compile(r"[@☎\d/]|[wW]{3}").search
WORDS = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’.-]*").findall
SUBJECT = regex.compile(r"^(?:\s*(?:re|aw|fwd?|wg|tr|rv|sv|antw)\s*:\s*)+", regex.I)


def disclaims(text: str) -> bool:
    return DISCLAIMER.search(text.lower()) is not None


def notifies(text: str) -> bool:
    return NOTICE.search(text.lower()) is not None


def reaches(text: str) -> bool:
    """Does this line say how to reach someone? Few lines hold a character without which none does."""
    return REACHED(text) is not None and CONTACT.search(text) is not None


@dataclass
class Line:
    number: int
    text: str
    depth: int = 0
    signature_box: bool = False
    shows: bool = False
    zone: str = ""
    marks: int = 0


@dataclass
class Mail:
    """The lines of one body, and who sent it"""

    lines: list[Line]
    is_html: bool
    names: frozenset[str] = field(default_factory=frozenset)
    initial: str = ""


def body_of(text: str | None, html: str | None) -> tuple[str | None, bool]:
    """The body and whether it is HTML: text if it shows a non-blank character, else html if that does, else none."""
    if text and text.strip():
        return text, False
    return (html, True) if html and html.strip() else (None, False)


def unprefixed(text: str) -> tuple[int, str]:
    """Number of quote marks at the head of a line, and the line without them."""
    m = PREFIX.match(text)
    if not m:
        return 0, text.strip()
    return m.group().count(">") + m.group().count("|"), text[m.end() :].strip()


def plain_lines(body: str) -> list[Line]:
    out = []
    for i, raw in enumerate(body.split("\n"), 1):
        depth, text = unprefixed(raw.replace("\r", "").replace(" ", " "))
        out.append(Line(i, text, depth, False, any(map(str.isalnum, text)), marks=depth))
    return out


def html_lines(body: str) -> list[Line]:
    """Each source line as it shows, with the quoting containers and the signature container around it."""
    out: list[Line] = []
    open_: list[tuple[str, bool, bool]] = []
    for i, raw in enumerate(body.split("\n"), 1):
        shown, at, boxes = [], 0, None
        for m in [*TAG.finditer(raw), None]:
            piece = raw[at : m.start()] if m else raw[at:]
            if piece.strip():
                shown.append(piece)
                if boxes is None:
                    boxes = (sum(q for _, q, _ in open_), any(s for _, _, s in open_))
            if m is None:
                break
            at = m.end()
            name = (m.group(2) or "").lower()
            if not name or name in VOID or m.group(3).endswith("/"):
                continue
            if not m.group(1):
                quote = name == "blockquote" or bool(QUOTE_BOX.search(m.group(3)))
                open_.append((name, quote, not quote and bool(SIGNATURE_BOX.search(m.group(3)))))
            elif any(n == name for n, _, _ in open_):
                while open_.pop()[0] != name:
                    pass
        text = entities.unescape("".join(shown)).replace(" ", " ").replace("\r", "")
        depth, text = unprefixed(text)
        boxes = boxes or (sum(q for _, q, _ in open_), any(s for _, _, s in open_))
        out.append(Line(i, text, depth + boxes[0], boxes[1], any(map(str.isalnum, text)), marks=depth))
    return out


def people(text: str | None) -> tuple[list[str], str]:
    """Name tokens (given name first) and first initial of a From value."""
    text = text or ""
    shown = EMAIL.sub("", text).strip(" <>\"'\t")
    if shown:
        if "," in shown:
            last, _, given = shown.partition(",")
            shown = f"{given} {last}"
        names = [w.lower() for w in WORDS(shown)]
        return names, names[0][:1] if names else ""
    local = (EMAIL.search(text) or [""])[0].partition("@")[0].lower()
    parts = [p for p in regex.split(r"[._\-\d]+", local) if p]
    return [p for p in parts if len(p) > 1], parts[0][:1] if parts else ""


def parse(text: str | None, html: str | None, from_: str | None) -> Mail | None:
    body, is_html = body_of(text, html)
    if body is None:
        return None
    names, initial = people(from_)
    mail = Mail(html_lines(body) if is_html else plain_lines(body), is_html, frozenset(names), initial)
    lay_out(mail)
    return mail


def names_sender(mail: Mail, text: str) -> bool:
    """Is this line the sender's name, perhaps with a title after a bar?"""
    head = text.split("|")[0].strip(" *_-–—")
    tokens = [w.lower().strip(".") for w in WORDS(head)]
    if not tokens or len(tokens) > 5 or head.endswith((",", ":", ";")) or len(head) > 60:
        return False
    if all(t in mail.names or len(t) == 1 for t in tokens) and any(t in mail.names and len(t) > 2 for t in tokens):
        return len(tokens) > 1 or "|" in text
    return len(tokens) == 2 and tokens[1] in mail.names and tokens[0][:1] == mail.initial


def addressee(text: str) -> str:
    """The first name a greeting speaks to, or nothing."""
    m = GREETING.fullmatch(text)
    if m:
        words = WORDS(m.group(1))
        return words[0].lower() if words and len(words) <= 4 else ""
    m = CALLED(text)
    return m.group(1).lower() if m else ""


def header_end(lines: list[Line], i: int) -> int:
    """End of the header of an earlier message that starts at line i, or i if none does."""
    j, fields, divided = i, 0, False
    depth = lines[i].depth
    while j < len(lines):
        x = lines[j]
        if not x.text or x.depth != depth:
            if fields or x.depth != depth or not divided or j - i > 3:
                break
        elif FIELD.match(x.text):
            if fields >= 2 and AUTHOR_FIELD.match(x.text):
                break
            fields += 1
        elif fields == 0 and (DIVIDER.fullmatch(x.text) or (SEPARATOR.fullmatch(x.text) and len(x.text) >= 5)):
            divided = divided or bool(DIVIDER.fullmatch(x.text)) or None
        elif fields and j + 1 < len(lines) and lines[j + 1].depth == depth and FIELD.match(lines[j + 1].text):
            pass
        else:
            break
        j += 1
    return j if fields >= 2 or (divided and j > i) else i


def intro_end(lines: list[Line], i: int) -> int:
    """End of the line, perhaps broken, that introduces an earlier message and starts at line i, or i if none does."""
    text = ""
    for j in range(i, min(i + 3, len(lines))):
        x = lines[j]
        if not x.text or x.depth != lines[i].depth:
            return i
        if j > i and x.text.endswith(":") and INTRO.fullmatch(x.text) and len(WORDS(text)) > 4 and not STARTS.match(text):
            return i
        text = f"{text} {x.text}".strip()
        if len(text) > INTRO_CHARS:
            return i
        if text.endswith(":"):
            told = INTRO.fullmatch(text) and VERB.search(text)
            return j + 1 if told and (regex.search(r"\d|@", text) or len(WORDS(text)) <= 6) else i
        if SENTENCE_END(x.text) and not EMAIL.search(x.text):
            return i
    return i


def unquote_amounts(lines: list[Line]) -> None:
    """A mark before a figure on a line alone ("> 40 percent of …") says "more than"; it quotes nothing."""
    shown = [x for x in lines if x.text]
    for above, x, below in zip([None, *shown], shown, [*shown[1:], None]):
        alone = (above is None or not above.depth) and (below is None or not below.depth)
        if x.depth == 1 and x.marks == 1 and alone and x.text[0].isdigit() and not (above and above.text.endswith(":")):
            x.depth = x.marks = 0


def lay_out(mail: Mail) -> None:
    """Give every line its zone: new, quote, intro, history, signature, device, disclaimer, notice or postscript."""
    lines = mail.lines
    unquote_amounts(lines)
    n = len(lines)
    zone, i, since_blank = "new", 0, True
    while i < n:
        x = lines[i]
        if not x.text:
            since_blank = True
            i += 1
            continue
        if x.depth:
            x.zone = "quote"
            if zone == "signature":
                zone = "new"
            since_blank = False
            i += 1
            continue
        end = header_end(lines, i)
        end = end if end > i else intro_end(lines, i)
        if end > i:
            for y in lines[i:end]:
                y.zone = "intro" if y.text else ""
            # An earlier message without quote marks runs to the end; one with marks ends with them.
            after = next((y for y in lines[end:] if y.text), None)
            if after is not None and not after.depth:
                zone = "history"
            i, since_blank = end, True
            continue
        if zone == "history":
            x.zone = "history"
            since_blank = False
            i += 1
            continue
        # A wrapped line of a quotation that lost its mark stands right below the quotation.
        if i and lines[i - 1].text and lines[i - 1].zone == "quote" and not since_blank:
            j = i
            while j < n and lines[j].text and not lines[j].depth and j - i < 3:
                j += 1
            above, whole = lines[i - 1].text, " ".join(y.text for y in lines[i:j])
            broken = len(above) > 40 and not STOP(above)
            if (j < n and lines[j].depth) or (j - i <= 3 and not names_sender(mail, x.text) and (broken or disclaims(whole) or notifies(whole) or reaches(whole))):
                for y in lines[i:j]:
                    y.zone = "quote"
                i = j
                continue
        stop = i
        while stop < n and lines[stop].text and not lines[stop].depth:
            stop += 1
        if since_blank or SEPARATOR.fullmatch(lines[i - 1].text):
            whole = " ".join(y.text for y in lines[i:stop])
            kind = "disclaimer" if disclaims(whole) else "notice" if notifies(whole) else ""
            if kind and stop - i <= 8 and not any(CLOSING.fullmatch(y.text.rstrip(",.! ")) or names_sender(mail, y.text) for y in lines[i:stop]):
                for y in lines[i:stop]:
                    y.zone = kind
                i, since_blank = stop, False
                continue
        since_blank = False
        text = x.text
        if POSTSCRIPT.match(text):
            for y in lines[i:stop]:
                y.zone = "postscript"
            i = stop
            continue
        if DEVICE.fullmatch(text):
            x.zone, zone = "device", "signature"
            i += 1
            continue
        if zone == "new":
            follow = next((y for y in lines[i + 1 :] if y.text and not SEPARATOR.fullmatch(y.text)), None)
            closing = CLOSING.fullmatch(text.rstrip(",.!;–- "))
            separated = SEPARATOR.fullmatch(text) and follow is not None and not follow.depth and (names_sender(mail, follow.text) or reaches(follow.text) or notifies(follow.text))
            named = names_sender(mail, text) and not GREETING.fullmatch(text)
            if x.signature_box or separated or named or (closing and len(text) < 48 and (follow is None or len(WORDS(follow.text)) <= 8 or follow.depth or disclaims(follow.text))):
                zone = "signature"
        x.zone = zone
        i += 1


FEATURES = (
    "quoted depth wrapped introduces below_intro below_closing device postscript box html lines words sentence_ends contacts density "
    "closing named greeting greets_sender separated top bottom short quotation disclaimer_words notice_words "
    "sender_repeats corpus_repeats thread_repeats"
).split()


@dataclass
class Block:
    lines: list[Line]
    features: list[float]
    label: int


def blocks_of(mail: Mail) -> list[Block]:
    """Blocks in order, without the features of the corpus. Labels, as far as layout tells: 1 not new, 0 new, -1 in doubt."""
    groups: list[list[Line]] = []
    fresh, separated = True, False
    marks: list[bool] = []
    for x in mail.lines:
        if not x.text:
            fresh = True
            continue
        if not x.shows:
            separated = bool(SEPARATOR.fullmatch(x.text))
            continue
        if fresh or separated or not groups or groups[-1][-1].zone != x.zone or (groups[-1][-1].depth > 0) != (x.depth > 0):
            groups.append([])
            marks.append(separated)
        groups[-1].append(x)
        fresh = separated = False
    out = []
    below_intro = below_closing = 0
    for k, (g, parted) in enumerate(zip(groups, marks, strict=True)):
        texts = [x.text for x in g]
        whole = " ".join(texts)
        words = [len(WORDS(t)) for t in texts]
        n, zone = len(g), g[0].zone
        ends = sum(bool(SENTENCE_END(t)) for t in texts)
        contacts = sum(map(reaches, texts))
        mean = sum(words) / n
        greeted = addressee(texts[0])
        closing = any(CLOSING.fullmatch(t.rstrip(",.!;–- ")) for t in texts)
        named = any(names_sender(mail, t) for t in texts)
        told, noted = disclaims(whole), notifies(whole)
        depth = max(x.depth for x in g)
        introduces, device, postscript = zone == "intro", bool(DEVICE.fullmatch(texts[0])), bool(POSTSCRIPT.match(texts[0]))
        # How many blocks above an introducing line stands that no marks follow, and a closing formula or name.
        below_intro = below_intro + 1 if below_intro and not depth and not introduces else int(zone == "history")
        below_closing = 0 if depth or postscript or zone == "new" else below_closing + 1 if below_closing else int(closing or named or device or zone == "signature")
        values = [
            depth > 0, min(depth, 6), zone == "quote" and not depth, introduces, min(below_intro, 6), min(below_closing, 6), device, postscript,
            any(x.signature_box for x in g), mail.is_html, min(n, 30), mean, ends / n, contacts, contacts / n,
            closing, named, bool(greeted), bool(greeted) and greeted in mail.names, parted, k / max(1, len(groups) - 1), (len(groups) - 1 - k) / max(1, len(groups) - 1),
            sum(w <= 4 for w in words) / n, sum(t[:1] in "“\"„«" for t in texts) / n, told, noted,
        ]
        if zone in ("quote", "intro", "history", "device", "disclaimer", "notice"):
            label = 1
        elif zone == "signature":
            label = 1 if closing or named or contacts or mean <= 6 or parted else -1
        elif zone == "postscript":
            label = 0
        else:
            label = 0 if greeted or (mean >= 5 and not told and not noted and not contacts) else -1
        out.append(Block(g, [float(v) for v in values], label))
    return out


def _hash(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\x1f".join(parts))
    return h - (1 << 64) if h >= 1 << 63 else h


BLOCKS = "mail_id bigint, version bigint, block int, lines array<int>, keys array<bigint>, features array<double>, label int"


def blocks(mails: DataFrame) -> DataFrame:
    """A row a block: the numbers of its lines that show something, three keys a line (of sender, corpus and thread, one
    after the other), features and label. ``version`` tells rows of one mail_id with different bodies apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for mail_id, text, html, from_, subject in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mail = parse(text, html, from_)
                if mail is None:
                    continue
                sender = (EMAIL.search(from_ or "") or [from_ or ""])[0].lower()
                thread = SUBJECT.sub("", subject or "").strip().lower()
                version = _hash(text or "", html or "", from_ or "", subject or "")
                for k, block in enumerate(blocks_of(mail)):
                    keys = []
                    for x in block.lines:
                        bare = "".join(filter(str.isalnum, x.text.lower()))
                        keys += [_hash("s", sender, bare), _hash("c", bare), _hash("t", thread, bare)]
                    for column, value in zip(out, (mail_id, version, k, [x.number for x in block.lines], keys, block.features, block.label), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split(" ")[0] for x in BLOCKS.split(", ")])

    rows = mails.select(F.col("mail_id").cast("bigint"), *(F.col(c).cast("string") for c in ("text", "html", "from_", "subject")))
    return rows.mapInArrow(run, BLOCKS)


def with_repeats(found: DataFrame) -> DataFrame:
    """Blocks with the corpus features: the mean of log(1 + other mails that hold its lines), by sender, corpus, thread.

    Counts are made before the join and only lines that come back are joined, so a line that a third of all mails end
    with is one row on its side; its other side is split by the adaptive skew join, and each block is small.
    """
    lines = found.select("mail_id", "version", "block", F.posexplode("keys").alias("at", "key"))
    counts = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    kind = F.col("at") % 3
    logs = F.log1p(F.coalesce(F.col("n"), F.lit(1)) - 1)
    sums = (
        lines.join(counts, "key", "left")
        .groupBy("mail_id", "version", "block")
        .agg(*(F.avg(F.when(kind == k, logs)).alias(f"r{k}") for k in range(3)))
        .toDF("m", "v", "b", "r0", "r1", "r2")
    )
    same = F.col("mail_id").eqNullSafe(F.col("m")) & F.col("version").eqNullSafe(F.col("v")) & F.col("block").eqNullSafe(F.col("b"))
    seen = found.join(sums, same)
    # The second view: other mails hold some of the lines, or marks, fields of a header or a rule above show
    # where they are from. Of
    # new text it tells nothing, as replies quote that.
    again = (F.col("r0") > 0) | (F.col("r1") > 0) | (F.col("r2") > 0)
    shown = F.exists(F.array(*(F.col("features")[FEATURES.index(c)] for c in ("quoted", "wrapped", "introduces", "separated"))), lambda x: x > 0)
    label = F.when((F.col("label") == 0) | ((F.col("label") == 1) & (again | shown)), F.col("label")).otherwise(-1)
    return seen.select("mail_id", "version", "block", "lines", "label", label.alias("agreed"), F.concat("features", F.array("r0", "r1", "r2")).alias("features"))


def not_new(mails: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(mail_id, line_no) of the lines of each body that show something and were not newly written by the sender.

    Mails need mail_id, text, html, from_, subject, each of which may be null; a mail with a blank body has no lines; a
    mail given twice counts once, two bodies under one mail_id are both judged; an empty table, or one without blocks
    of both labels to fit on, is judged by layout alone; other columns are ignored.
    """
    rows = mails.select("mail_id", "text", "html", "from_", "subject").dropDuplicates()
    all_ = cut(with_repeats(cut(blocks(rows), "blocks")), "features")
    labelled = all_.where("agreed >= 0").orderBy(F.xxhash64("mail_id", "version", "block"), "mail_id", "version", "block").limit(sample)
    fit_on = cut(labelled.select("features", F.col("agreed").cast("double").alias("label")), "sample")
    points = fit_on.select(array_to_vector("features").alias("v"), "label").coalesce(2).cache()
    both = {r[0] for r in points.select("label").distinct().collect()}
    if len(both) == 2:
        trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False, maxBins=32)
        model = trees.fit(points)
        points.unpersist()
        judged = model.transform(all_.withColumn("v", array_to_vector("features"))).where("prediction > 0.5")
    else:
        points.unpersist()
        judged = all_.where("label = 1")
    return judged.select("mail_id", F.explode("lines").alias("line_no")).distinct()


def new_text(mails: DataFrame, lines: DataFrame) -> DataFrame:
    """(mail_id, text) of every mail with a body: its lines as they show, without those found not to be new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for mail_id, text, html, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body, is_html = body_of(text, html)
                if body is None:
                    continue
                drop = set(gone or ())
                raw = body.split("\n")
                kept = []
                for x in html_lines(body) if is_html else plain_lines(body):
                    idle = not x.shows and (x.depth or SEPARATOR.fullmatch(x.text))
                    if x.number not in drop and not idle and (x.text or not is_html):
                        kept.append(x.text if is_html else raw[x.number - 1].rstrip("\r"))
                ids.append(mail_id)
                out.append(regex.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["mail_id", "text"])

    gone = lines.groupBy(F.col("mail_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    rows = mails.join(gone, F.col("mail_id").cast("bigint") == F.col("__id"), "left")
    return rows.select(F.col("mail_id").cast("bigint"), F.col("text").cast("string"), F.col("html").cast("string"), "__gone").mapInArrow(run, "mail_id bigint, text string")
