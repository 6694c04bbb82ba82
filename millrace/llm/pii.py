"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

1. Each text gives base spans (fixed patterns with their checks; these always
   stand) and wider candidates: worded and international addresses, numbers
   that a longer run of digits hides, other separators, national forms.
2. Six labelers vote yes, no or nothing on every candidate and base span: the
   form, a checksum or range, gazetteers, cue words before it, counter-cues
   around it, and what touches it.
3. Votes are counted by kind and pattern of votes over all documents.  The
   patterns are at most 3^6 a kind, so the counts go to the driver, where EM
   estimates how often each labeler says what on true and on false spans.
4. The posteriors label a bounded sample of candidates (TRAIN, smallest
   hashes), on which a logistic regression over votes, shape and context words
   is fitted; its weights, WIDTH numbers, are broadcast.
5. A second pass over the texts scores every candidate.  Those that fail their
   checksum or range are never accepted, nor are those that overlap a base
   span; of two that overlap the likelier one stays.

Work stays within the row but for the counts and the sample: texts are never
shuffled.

Edge cases: null and empty texts have no spans; repeated rows are searched
each; without candidates only base spans are found; an empty table gives an
empty result; other columns than doc_id and text aren't read.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_batches, stash

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the classifier is fitted on, its features, and the probability from which a candidate is accepted.
TRAIN, WIDTH, SURE = 20_000, 4_096, 0.7
#: Labelers, and the place of the one that knows the checksum or range.
LABELERS, CHECK = 6, 1
#: Characters before and after a span that labelers read.
AROUND = 48

# The base patterns, each begun where a run of digits begins.
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Markers of a worded or spaced address, and what may follow; after a bare "at" the dots must be words, too.
AT = re.compile(r"\s?(?:[(\[{<]\s?at\s?[)\]}>]|@)\s?|\sat\s", re.I)
DOT_WORD = r"(?:\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s)"
WORDED_HOST = re.compile(rf"[\w-]{{1,63}}(?:{DOT_WORD}[\w-]{{1,63}}){{1,4}}", re.I)
MIXED_HOST = re.compile(rf"[\w-]{{1,63}}(?:(?:\.|{DOT_WORD})[\w-]{{1,63}}){{1,4}}", re.I)
LOCAL_END = re.compile(r"[\w.%+-]{1,64}\Z")
#: Runs that hold whole cards and phones.
DIGITS = re.compile("[+(]?[0-9][0-9 ().+/ -]{6,}[0-9]")
WIDE = {
    "ip": (re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"), re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![\w.])")),
    "card": (
        re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
        re.compile("(?<![0-9])[0-9]{4}(?:([ . /-])[0-9]{4})(?:\\1[0-9]{4})\\1[0-9]{1,7}(?![0-9])"),
        re.compile("(?<![0-9])[0-9]{4}([ . /-])[0-9]{6}\\1[0-9]{5}(?![0-9])"),
    ),
    "phone": (
        re.compile(r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])"),
        re.compile(r"(?<![\w+(])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
        re.compile(r"(?<![\w+])00[1-9][0-9]{6,13}(?!\w)"),
    ),
}
STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"),
    "ip": re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}"),
    "card": re.compile(r"[0-9]{15,16}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}([ .-][0-9]{2,4}){1,4}|\([0-9]{2,4}\) ?[0-9]{3}[ .-][0-9]{4}"),
}
#: Gazetteers: common top-level domains, first digits of card issuers, calling codes.
DOMAINS = frozenset("com org net edu gov info biz io dev app eu uk de fr es it nl be at ch se no dk fi pl pt cz ie ru ua us ca mx br ar cl au nz jp cn kr in za tr gr".split())
ISSUERS = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|36|38|30[0-5]|6011|65|64[4-9]|35(?:2[89]|[3-8])|62|50|5[678]|6[37]|9[0-9]")
CODES = re.compile(r"(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})")
CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|kontakt|schreib\w*|courriel|adresse|correo|escrib\w*)\b", re.I),
    "ip": re.compile(r"\b(?:ip(?:v[46])?|host|server|address|client|from|login|adresse|serveur|servidor|direcci\w+)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|master\s?card|amex|debit|kreditkarte|karte|carte|tarjeta|payment|zahlung)\b", re.I),
    "phone": re.compile(r"\b(?:tel\w*|phone|call|mobile|cell|fax|whatsapp|anruf\w*|handy|rufnummer|appel\w*|portable|m[oó]vil|llam\w*)\b", re.I),
}
COUNTER = re.compile(r"(?:\b(?:version|ver|v|isbn|issn|doi|order|invoice|id|no|nr|page|pp|section|chapter|figure|table|serial|token|hash|key|build|bestellung|rechnung|seite|commande|facture|pedido|factura)\b[.:#=\s]*|[#€$£%=]\s?\"?)\Z", re.I)
WORD_BEFORE, WORD_AFTER = re.compile(r"(\w+)\W*\Z"), re.compile(r"\W*(\w+)")
Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans of a text by kind and start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        host, start = HOST.match(text, at), at
        while host and start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append(("email", start, host.end()))
            end = host.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Wider spans of a text that overlap no base span."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], np.int64)
    # base spans of different kinds may overlap, so ends are carried on
    ends = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else np.zeros(0, np.int64)

    def free(a: int, b: int) -> bool:
        upto = int(np.searchsorted(starts, b))  # spans that begin before b
        return upto == 0 or ends[upto - 1] <= a

    out = set()
    for m in AT.finditer(text):
        host = (WORDED_HOST if m.group().strip().isalpha() else MIXED_HOST).match(text, m.end())
        local = LOCAL_END.search(text[max(0, m.start() - 64) : m.start()]) if host else None
        if local and free(m.start() - len(local.group()), host.end()):
            out.add(("email", m.start() - len(local.group()), host.end()))
    if ":" in text or "[.]" in text or "(.)" in text:
        out |= {("ip", m.start(), m.end()) for p in WIDE["ip"] for m in p.finditer(text) if free(m.start(), m.end())}
    for run in DIGITS.finditer(text):
        a, b = run.start(), min(run.end() + 1, len(text))  # lookahead sees one character beyond the run
        for kind in ("card", "phone"):
            out |= {(kind, m.start(), m.end()) for p in WIDE[kind] for m in p.finditer(text, a, b) if free(m.start(), m.end())}
    return sorted(out, key=lambda s: (KINDS.index(s[0]), *s[1:]))


def plain_email(found: str) -> str:
    """A worded address in its usual form."""
    return re.sub(r"\s", "", re.sub(DOT_WORD, ".", AT.sub("@", found, count=1), flags=re.I))


def holds(kind: str, found: str) -> bool:
    """The checksum or range of a kind."""
    if kind == "email":
        return re.search(r"\.[^\W\d_]{2,24}\Z", plain_email(found)) is not None
    if kind == "ip":
        try:
            return bool(ipaddress.ip_address(re.sub(r"[\[\]()]", "", found)))
        except ValueError:  # not an address: that is the answer, leading zeros included
            return False
    digits = digits_of(found)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def known(kind: str, found: str) -> int:
    """What the gazetteers say of a span."""
    if kind == "email":
        return 1 if plain_email(found).rsplit(".", 1)[-1].lower() in DOMAINS else -1
    if kind == "card":
        return 1 if ISSUERS.match(digits_of(found)) else -1
    if kind == "phone":
        return 1 if CODES.match(found) else 0
    return -1 if re.match(r"0|127\.|255\.|::", found) else 0


def votes(text: str, span: Span) -> list[int]:
    """The labelers' votes on a span: 1, -1, or 0 for none."""
    kind, a, b = span
    found, before, after = text[a:b], text[max(0, a - AROUND) : a], text[b : b + 2]
    touches = (before[-1:].isalnum() or before[-1:] in ("_", "@", "/")) or after[:1].isalnum() or after[:1] in ("_", "@", "%") or (after[:1] in (".", ",", "-") and after[1:].isdigit())
    return [
        1 if STRICT[kind].fullmatch(found) else -1,
        1 if holds(kind, found) else -1,
        known(kind, found),
        1 if CUES[kind].search(before) else 0,
        -1 if COUNTER.search(before) else 0,
        -1 if touches else 1,
    ]


def features(text: str, span: Span, vote: list[int]) -> list[int]:
    """Hashed features of a span: votes, shape, and the words around it."""
    kind, a, b = span
    found = text[a:b]
    before, after = WORD_BEFORE.search(text[max(0, a - AROUND) : a]), WORD_AFTER.match(text[b : b + AROUND])
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", found))[:24]
    named = [kind, f"{kind} shape {shape}", f"{kind} digits {len(digits_of(found))}", *(f"{kind} {i} {v}" for i, v in enumerate(vote))]
    named += [f"{kind} before {before[1].lower()}" if before else f"{kind} first", f"{kind} after {after[1].lower()}" if after else f"{kind} last"]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in named]


def code(vote: list[int]) -> int:
    """Votes as one number, base 3."""
    return sum((v + 1) * 3**i for i, v in enumerate(vote))


def reliabilities(patterns: np.ndarray, counts: np.ndarray, steps: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over patterns of votes [n, labelers] with their counts: (share of true spans, P(vote | truth) [labelers, 2, 3], P(true | pattern)).

    Votes are independent given the truth.  Sums begin with a prior by which a
    labeler errs less often than it is right.  A failed checksum or range is
    proof, so those patterns stay false.
    """
    prior = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # false: no, none, yes; true alike
    failed = patterns[:, CHECK] < 0
    truth = np.where(failed, 0.0, 1 / (1 + np.exp(-2.0 * patterns.sum(axis=1))))
    onehot = patterns[:, :, None] == np.array([-1, 0, 1])
    share, table = 0.5, np.zeros((patterns.shape[1], 2, 3))
    for _ in range(steps):
        for y, weight in enumerate((1 - truth, truth)):
            table[:, y] = ((weight * counts)[:, None, None] * onehot).sum(axis=0) + prior[y]
        table /= table.sum(axis=2, keepdims=True)
        share = ((truth * counts).sum() + 1) / (counts.sum() + 2)
        log = (np.log(table)[None] * onehot[:, :, None, :]).sum(axis=(1, 3)) + np.log([1 - share, share])
        truth = np.where(failed, 0.0, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50))))
    return share, table, truth


def fitted(rows: list[list[int]], truth: np.ndarray, width: int = WIDTH, steps: int = 1000, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on sets of feature numbers with soft labels, by gradient steps with momentum."""
    weights, speed = np.zeros(width), np.zeros(width)
    if not rows:
        return weights
    row, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.asarray(r, np.int64) for r in rows])
    for _ in range(steps):
        odds = np.bincount(row, weights[column], len(rows))
        error = 1 / (1 + np.exp(-np.clip(odds, -50, 50))) - truth
        speed = 0.9 * speed - rate * (np.bincount(column, error[row], width) / len(rows) + decay * weights)
        weights = weights + speed
    return weights


def candidate_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, at, kind, pattern, features) of every base span and candidate of docs (doc_id, text)."""

    def work(frames):
        for frame in blocks(frames, "text"):
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                if not isinstance(text, str):
                    continue
                base = base_spans(text)
                for span in base + candidates(text, base):
                    vote = votes(text, span)
                    rows.append((doc, span[1], span[0], code(vote), features(text, span, vote)))
            yield pd.DataFrame(rows, columns=["doc_id", "at", "kind", "pattern", "features"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, at long, kind string, pattern int, features array<int>")


def trained(docs: DataFrame, train: int = TRAIN) -> tuple[dict, np.ndarray]:
    """(P(true | pattern) by kind and pattern, the classifier's weights)."""
    found = stash(candidate_rows(docs), "candidates")
    # at most 3^6 patterns a kind
    counts = found.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["kind", "pattern"])
    truth: dict = {}
    for kind, part in counts.groupby("kind"):
        patterns = part["pattern"].to_numpy()[:, None] // 3 ** np.arange(LABELERS) % 3 - 1
        truth |= {(kind, int(p)): float(t) for p, t in zip(part["pattern"], reliabilities(patterns, part["n"].to_numpy(np.float64))[2])}
    order = [F.xxhash64("doc_id", "at", "kind"), "kind", "pattern", "at", "doc_id"]
    sample = found.orderBy(*order).limit(train).select("kind", "pattern", "features").collect()
    return truth, fitted([r.features for r in sample], np.array([truth[r.kind, r.pattern] for r in sample]))


def decided(text: str, weights: np.ndarray, sure: float = SURE) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, probability) of every span of a text, by kind and start."""
    base = base_spans(text)
    scored = []
    for span in candidates(text, base):
        vote = votes(text, span)
        odds = float(weights[features(text, span, vote)].sum())
        p = 1 / (1 + np.exp(-min(max(odds, -50.0), 50.0)))
        if vote[CHECK] > 0 and p >= sure:
            scored.append((p, span))
    added: list[tuple[str, int, int, bool, float]] = []
    starts: list[int] = []
    ends: list[int] = []
    for p, (kind, a, b) in sorted(scored, key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
        at = bisect.bisect_left(starts, b)
        if at == 0 or ends[at - 1] <= a:  # accepted spans don't overlap each other
            starts.insert(at, a)
            ends.insert(at, b)
            added.append((kind, a, b, False, float(p)))
    return sorted([(*s, True, 1.0) for s in base] + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_pii(docs: DataFrame, train: int = TRAIN, sure: float = SURE) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base, p>>, masked) of every row of docs (doc_id, text); offsets in code points, masked is the text with <kind> in place of each span."""
    weights = docs.sparkSession.sparkContext.broadcast(trained(docs, train)[1])

    def masked(text: str, spans: list) -> str:
        out, at = [], 0
        for kind, a, b, *_ in sorted(spans, key=lambda s: s[1:3]):
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def work(frames):
        for frame in blocks(frames, "text"):
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            found = [decided(t, weights.value, sure) for t in texts]
            named = [[dict(zip(("kind", "start", "end", "base", "p"), s)) for s in spans] for spans in found]
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "spans": named, "masked": [masked(t, s) for t, s in zip(texts, found)]})

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean, p: double>>, masked string")
