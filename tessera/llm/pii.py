"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns of the contract give the base spans, each found in linear time whatever the text. The field then looks at
the places around digits, "at" signs and long opaque strings, however long they are: there it scores candidate segments of
bounded length, and the whole place, by features of the whole segment, and dynamic programming chooses boundaries and kinds
together. Everything outside those places is no entity, so the segmentation of a text is the best one of each place.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, lru_cache
from importlib import resources
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import arrow_map, arrow_replace

#: Order in which kinds are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Fixed by the contract.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass Luhn's check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches; each sign's local part is looked for backwards, so no character is read twice."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    parts = lambda m: all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split(".")))
    return [m.span() for m in IP.finditer(text) if parts(m)]


def digits_in(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    return [m.span() for m in CARD.finditer(text) if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := digits_in(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_in(m.group())) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    return {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}


# ---- the field

#: Places that are looked at, of any length; no character is read more often than a fixed number of times.
_RUN = r"[A-Za-z0-9_+/-]{20,}+(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
PLACE = re.compile(
    r"(?<![A-Za-z0-9_+/.-])/*+eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{4,}+){1,4}"
    r"|(?<![A-Za-z0-9._%+-])(?<! dot )(?<! DOT )[A-Za-z0-9._%+-]++(?: (?:dot|DOT) [A-Za-z0-9._%+-]++)*+ (?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)++"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\{(?:at|AT)\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\{(?:dot|DOT)\}) ?[A-Za-z0-9-]++)++"
    rf"|(?<![A-Za-z0-9_+/-])(?=[0-9_+/-]*+[A-Za-z]){_RUN}"
    r"|(?<![A-Za-z0-9])\(?[0-9]{2,}+\)?(?:[ .()/-]{1,2}[0-9]++)+(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9_+/-])(?=[_+/-]*+[0-9]){_RUN}"
)
#: An equals sign parts a name from its value; only at the end it is padding.
TOKEN = re.compile(r"[A-Za-z0-9_]+(?:={1,2}(?![A-Za-z0-9_+/=-]))?|[^\sA-Za-z0-9_]")
#: What is looked at of a place beside base spans.
PART = re.compile(r"[A-Za-z0-9_+(\[{](?:.*[A-Za-z0-9_=)\]}])?", re.S)
CUE = re.compile(r"([A-Za-z_]+)[\s:=\"'(#]*$")
#: Longest segment, in tokens, besides a whole place; digits of a number; signs of an opaque run.
LONGEST, LEAST_DIGITS, MOST_DIGITS, OPAQUE = 14, 6, 20, 20
RUN = re.compile("[A-Za-z0-9_+/=-]+")
#: Words before a span that tell its kind.
CUES = {
    "email": "mail email e-mail contact write".split(), "ip": "ip host server address addr".split(), "card": "card visa mastercard amex credit".split(),
    "phone": "phone tel telephone call fax mobile cell whatsapp".split(), "secret": "token key secret password passwd pwd apikey api_key access_key bearer credential credentials".split(),
    "not": "version v order invoice page isbn no id year section figure table release".split(),
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws}
#: What published kinds of keys and tokens begin with.
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk_live_ sk_test_ rk_live_ sk- xoxb- xoxp- xoxa- AIza npm_ hf_ eyJ".split()
PREFIX = re.compile("|".join(map(re.escape, KEY_PREFIXES)))
#: Where small letters turn to capitals; runs of one class of sign.
TURN = re.compile("[a-z][A-Z]")
CLASS_RUN = re.compile("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")
AT = re.compile(r"[(\[{](?:at|AT)[)\]}]| (?:at|AT) ")
HEX = re.compile("[0-9a-f-]+")
DOT = re.compile(r"\b(?:dot|DOT)\b")


def free_parts(text: str, start: int, end: int, taken: list[Span]) -> list[Span]:
    """What base spans (by start) leave of a place, without the separators at its ends."""
    out = []
    for a, b in [*taken, (end, end)]:
        if start < a and (m := PART.search(text, start, min(a, end))):
            out.append(m.span())
        start = max(start, b)
    return out


def places_of(text: str, base: dict[str, list[Span]]) -> Iterator[Span]:
    """The places of a text, each split at the base spans in it."""
    taken = sorted(s for spans in base.values() for s in spans)
    ends = list(accumulate((b for _, b in taken), max))
    first = 0
    for m in PLACE.finditer(text):
        start, end = m.span()
        while text[start] == "/" and start < end - 1:  # of an address
            start += 1
        while first < len(taken) and ends[first] <= start:
            first += 1
        last = first
        while last < len(taken) and taken[last][0] < end:
            last += 1
        yield from free_parts(text, start, end, taken[first:last]) if last > first else [(start, end)]


def cue_of(before: str) -> str:
    """The kind of the word that a text ends with."""
    if not (m := CUE.search(before)):
        return ""
    word = m[1].lower()
    return _CUE_OF.get(word) or next((_CUE_OF[p] for p in reversed(word.split("_")) if p in _CUE_OF), "")


def segment_features(seg: str, before: str, whole: bool, lead: str) -> tuple[str, ...]:
    """Features of a whole segment; ``whole`` says that it fills its place, ``lead`` is the cue before the place. Those of short
    segments are remembered, as places that go on for long repeat themselves."""
    return (_features if len(seg) <= 200 else _features.__wrapped__)(seg, cue_of(before), whole, lead)


@lru_cache(1 << 16)
def _features(seg: str, cue: str, whole: bool, lead: str) -> tuple[str, ...]:
    d = digits_in(seg)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", seg))
    out = [f"len{min(len(seg) // 6, 8)}", f"dig{min(len(d), 20)}", "whole" if whole else "part", f"cue-{cue}", f"lead-{lead}", f"at{bool(AT.search(seg))}", f"dot{bool(DOT.search(seg))}"]
    if len(shape) <= 12:
        out.append(f"shape-{shape}")
        if "a" not in shape:
            out.append("groups" + ".".join(str(len(g)) for g in re.findall("[0-9]+", seg)))
    if 13 <= len(d) <= 19:
        out.append(f"luhn{luhn(d)}")
    if len(seg) >= 20 and (m := PREFIX.match(seg)):
        out += [f"prefix-{m[0]}", f"prefix{whole}"]
    if re.fullmatch(r"[A-Za-z0-9_+/=-]{20,}", seg):
        kinds = (any(c.islower() for c in seg)) + (any(c.isupper() for c in seg)) + bool(d)
        out += [f"opaque{kinds}", f"mix{min(4, 8 * len(d) // len(seg))}", f"runs{min(6, len(re.findall('[0-9]+', seg)))}", f"opaquecue-{cue}"]
        out += [f"chaos{kinds}.{10 * len(CLASS_RUN.findall(seg)) // len(seg)}", f"hex{bool(HEX.fullmatch(seg))}"]
        if not d:
            out += [f"digitlesscue-{cue}", f"turns{min(4, 10 * len(TURN.findall(seg)) // len(seg))}"]
    if seg[0] in "(" and ")" in seg:
        out.append("paren")
    return tuple(out)


def tokens_of(text: str, start: int, end: int) -> list[Span]:
    return [m.span() for m in TOKEN.finditer(text, start, end)]


def segments(text: str, start: int, end: int, tokens: list[Span]) -> Iterator[tuple[int, int, list[str] | None]]:
    """Candidate segments of a place (first token, end token, features), by end and first: up to ``LONGEST`` tokens, or all of it.

    An entity is the whole place, an opaque run, holds an "at" sign in words, or has as many digits as a number may have
    between fitting ends. Other segments can't be one: a single token has no features then, a longer one is left out.
    """
    lead, n = cue_of(text[max(0, start - 24) : start]), len(tokens)
    digits = list(accumulate((len(digits_in(text[a:b])) for a, b in tokens), initial=0))
    ats = [m.span() for m in AT.finditer(text, start, end)]
    opens = [text[a].isalnum() or text[a] in "(+" for a, _ in tokens]
    closes = [text[b - 1].isalnum() or text[b - 1] in ")]}=" for _, b in tokens]
    for j in range(1, n + 1):
        b = tokens[j - 1][1]
        for i in ([0] if j == n > LONGEST else []) + list(range(max(0, j - LONGEST), j)):
            a = tokens[i][0]
            fits = (
                (opens[i] and closes[j - 1] and LEAST_DIGITS <= digits[j] - digits[i] <= MOST_DIGITS)
                or (a, b) == (start, end)
                or (b - a >= OPAQUE and RUN.fullmatch(text, a, b))
                or ((k := bisect_left(ats, (a, 0))) < len(ats) and ats[k][1] <= b)
            )
            if fits:
                yield i, j, segment_features(text[a:b], text[max(0, a - 24) : a], (a, b) == (start, end), lead)
            elif j == i + 1:
                yield i, j, None


def lattice(text: str, start: int, end: int) -> tuple[list[Span], list[tuple[int, int, list[str] | None]]]:
    """Tokens of a place, and its candidate segments."""
    tokens = tokens_of(text, start, end)
    return tokens, list(segments(text, start, end, tokens))


def _scored(segs, weights: dict[str, float], memo: dict | None = None) -> Iterator[tuple[int, int, int, float]]:
    """(first, end, kind, score): kind -1 is no entity, one token long. ``memo`` keeps the scores of features, under one set of weights."""
    for i, j, feats in segs:
        if j == i + 1:
            yield i, j, -1, 0.0
        if feats is None:
            continue
        scores = None if memo is None else memo.get(feats)
        if scores is None:
            scores = [weights.get(f"{kind}|bias", 0.0) + sum(weights.get(f"{kind}|{f}", 0.0) for f in feats) for kind in KINDS]
            if memo is not None:
                if len(memo) >= 1 << 16:
                    memo.clear()
                memo[feats] = scores
        for k, score in enumerate(scores):
            yield i, j, k, score


def _scores(segs, weights: dict[str, float]) -> list[tuple[int, int, int, float]]:
    return list(_scored(segs, weights))


def decode(n: int, scored) -> list[tuple[int, int, int]]:
    """The best segmentation of ``n`` tokens: its entities."""
    return _best(n, sorted(scored, key=lambda x: (x[1], x[0], x[2])))


def _best(n: int, scored) -> list[tuple[int, int, int]]:
    """:func:`decode` of scores that come by end, first and kind; they are read once, so a long place needs little memory."""
    score, last = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for i, j, k, s in scored:
        if score[i] + s > score[j]:
            score[j], last[j] = score[i] + s, (i, j, k)
    out, at = [], n
    while at:
        step = last[at]
        if step[2] >= 0:
            out.append(step)
        at = step[0]
    return out[::-1]


def _log_add(xs: list[float]) -> float:
    top = max(xs, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def gradient(n: int, segs, gold: set[tuple[int, int, int]], weights: dict[str, float]) -> dict[str, float]:
    """Observed minus expected features of one place: the slope of the log-likelihood."""
    scored = _scores(segs, weights)
    into, outof = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for s in scored:
        into[s[1]].append(s)
        outof[s[0]].append(s)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = _log_add([alpha[i] + s for i, _, _, s in into[j]])
    for i in range(n - 1, -1, -1):
        beta[i] = _log_add([beta[j] + s for _, j, _, s in outof[i]])
    feats = {(i, j): f for i, j, f in segs}
    out: dict[str, float] = {}
    for i, j, k, s in scored:
        if k >= 0 and (p := ((i, j, k) in gold) - math.exp(alpha[i] + s + beta[j] - alpha[n])):
            for f in ("bias", *feats[i, j]):
                out[f"{KINDS[k]}|{f}"] = out.get(f"{KINDS[k]}|{f}", 0.0) + p
    return out


#: How local numbers are written in some countries.
LOCAL_PHONES = ["0{2} {7}", "0{2}-{7}", "0{2}/{8}", "0{3}/{7}", "0{3}-{7}", "(0{2}) {7}", "(0{3}) {6}", "0{3} {3} {4}", "0{2} {4} {4}", "0{1}.{2}.{2}.{2}.{2}", "0{1}-{2}-{2}-{2}-{2}", "{3} {2} {2} {2}", "{2} {3} {2} {2}", "{3}.{3}.{4}", "0{4} {3}{3}"]


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up labelled sentences: entities in the forms that the patterns miss, and look-alikes that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    ip = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    filled = lambda shape: re.sub(r"\{(\d)\}", lambda m: digits(int(m[1])), shape)
    north = lambda: filled(rng.choice(["({3}) {3}-{4}", "{3}-{3}-{4}", "{3} {3} {4}"]))

    def neighbours() -> list[tuple[str, str | None]]:
        """A local number in one place with what the patterns find; texts by turns with their kinds."""
        first = rng.choice(["", "", "phone ", "call ", "tel: "])
        other = rng.choice([ip(), filled("+1 {3} {3} {4}"), filled("+44 {2} {4} {4}")])
        sep = "/" if other[0] == "+" else rng.choice([" ", " ", "/"])
        return [(first, None), (north(), "phone"), (sep + other + " ", None)] if rng.random() < 0.4 else [(first + other + sep, None), (north(), "phone"), (" ", None)]

    def numbers() -> list[tuple[str, str | None]]:
        """A list of phone numbers in one place."""
        shape, sep = rng.choice(["({3}) {3}-{4}", "{3}-{3}-{4}", "{3} {3} {4}"]), rng.choice([" ", " ", "/"])
        out = [(rng.choice(["phone ", "tel: ", "call ", "fax ", "mobile: ", "", "+1 "]), None)]
        for _ in range(rng.randint(2, 8)):
            out += [(filled(shape), "phone"), (sep, None)]
        return [*out[:-1], (" ", None)]

    def opaque() -> list[tuple[str, str | None]]:
        """Secrets that are long or without a digit, and long names and rows of numbers that are none."""
        name = rng.choice(["token", "key", "secret", "password", "api_key"]) + rng.choice([" = ", ": ", "="])
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        run = lambda signs, k: rng.choice(letters) + "".join(rng.choice(signs) for _ in range(k - 1))
        form = rng.randrange(7)
        if form == 0:
            return [(name, None), (run(letters + "0123456789" + rng.choice(["", "+/", "_-"]), rng.choice([128, 200, 257, 300, 500])), "secret"), (" ", None)]
        if form in (1, 2):
            return [(name, None), (run(letters, rng.choice([20, 24, 32, 40, 64])), "secret"), (" ", None)]
        if form == 3:
            return [(run(letters, rng.choice([43, 50])) + digits(4) + run(letters, 9), "secret") if x else (name, None) for x in (0, 1)] + [(" ", None)]
        if form == 4:
            words = [word() for _ in range(rng.randint(5, 9))]
            return [(rng.choice(["", "see ", "page "]) + rng.choice(["-", "_", "/", ""]).join(words if rng.random() < 0.7 else [w.title() for w in words]) + " ", None)]
        return [(rng.choice(["", "table ", "no "]) + " ".join(digits(rng.choice([1, 2, 2, 3, 4, 4, 5])) for _ in range(rng.randint(3, 16))) + " ", None)]

    def published() -> list[tuple[str, str | None]]:
        """Keys and tokens of published kinds, with a name before them or not, and long names that look like them."""
        letters, lower, figures = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
        run = lambda signs, k: "".join(rng.choice(signs) for _ in range(k))
        lead = rng.choice(["", "", "use ", "key ", "token: ", "secret = ", "export API_KEY=", "Authorization: Bearer ", "credentials: ", "was ", "AWS_ACCESS_KEY_ID=", "id: ", "https://", "//"])
        form = rng.randrange(8)
        if form == 0:
            body = rng.choice(["AKIA", "ASIA"]) + run(lower.upper() + figures, 16)
        elif form == 1:
            body = rng.choice([x for x in KEY_PREFIXES if x not in ("AKIA", "ASIA", "eyJ")]) + run(letters + figures, rng.choice([24, 32, 36, 36, 40, 59]))
        elif form == 2:
            body = ".".join(["eyJ" + run(letters + figures, rng.randint(15, 40)), "eyJ" + run(letters + figures + "_-", rng.randint(30, 120)), run(letters + figures + "_-", rng.choice([22, 43, 86]))])
        elif form == 3:
            body = run(letters, 1) + run(letters + figures + "/+", 38) + run(letters, 1)
            lead = rng.choice(["", "aws_secret_access_key = ", "secret_access_key: ", "SecretAccessKey=", "AWS_SECRET_KEY=", "client_secret: "])
        elif form == 4:
            body = run(letters, 1) + run(letters + figures, rng.choice([31, 39, 63]))
            lead = lead.rstrip("/") if lead.endswith("//") else lead
        elif form == 5:
            return [(rng.choice(["", "id ", "see ", "request "]) + "-".join(run("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)) + " ", None)]
        elif form == 6:
            parts = [word().title() + rng.choice(["", "", digits(1)]) for _ in range(rng.randint(4, 8))]
            return [(rng.choice(["", "class ", "in "]) + rng.choice(["", "", "/", "_"]).join(parts) + " ", None)]
        else:
            return [(rng.choice(["", "sha256 ", "commit ", "md5 "]) + run("0123456789abcdef", rng.choice([32, 40, 64])) + " ", None)]
        return [(lead, None), (body, "secret"), ("@host " if lead.endswith("//") else " ", None)]

    def entity() -> tuple[str, str | None, str]:
        """What stands before it, its kind, its text."""
        form = rng.randrange(14)
        if form == 0:
            br = rng.choice(["()", "[]", "{}"])
            gap = rng.choice(["", " "])
            dot = rng.choice([".", f"{br[0]}dot{br[1]}"])
            name, end = rng.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}"]), rng.choice(["com", "org", "net", "de", "fr", "es", "co.uk"])
            if rng.random() < 0.3:
                return rng.choice(["", "mail ", "contact: ", "write to "]), "email", f"{name} at {word()} dot {end.replace('.', ' dot ')}"
            body = f"{name}{gap}{br[0]}at{br[1]}{gap}{word()}{gap if dot != '.' else ''}{dot}{gap if dot != '.' else ''}{end}"
            return rng.choice(["", "mail ", "contact: "]), "email", body.replace("at" + br[1], "AT" + br[1]).replace("dot" + br[1], "DOT" + br[1]) if rng.random() < 0.2 else body
        if form in (1, 2, 3):
            shape = rng.choice(["({3}) {3}-{4}", "{3}-{3}-{4}", "{4} {6}", "{3} {3} {4}", "{2} {2} {2} {2} {2}", "{3}/{7}".replace("{7}", "{6}"), "{5} {6}", *LOCAL_PHONES])
            cue = rng.choice(["phone ", "tel: ", "call ", "fax ", "mobile: "])
            return cue, "phone", filled(shape)
        if form in (4, 5, 6):
            size = rng.choice([20, 24, 32, 40, 40, 64])
            alphabet = rng.choice(["0123456789abcdef", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
            pad = rng.choice(["", "", "", "=", "=="])
            quote = rng.choice(['"', "'", ""])
            return rng.choice(["token", "key", "secret", "password", "api_key", "PASSWORD", "access_key"]) + rng.choice([" = ", ": ", "="]) + quote, "secret", "1a" + "".join(rng.choice(alphabet) for _ in range(size - 2)) + pad
        if form == 7:
            return rng.choice(["", "order ", "no "]), None, f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"
        if form == 8:
            return rng.choice(["", "version ", "release "]), None, ".".join(digits(rng.randint(2, 3)) for _ in range(rng.randint(2, 3)))
        if form == 9:
            return rng.choice(["", "on ", "year "]), None, rng.choice([f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.20{digits(2)}", f"19{digits(2)}-20{digits(2)}"])
        if form == 10:
            return rng.choice(["", "commit ", "see ", "id "]), None, "3f" + "".join(rng.choice("0123456789abcdef") for _ in range(38))
        if form == 11:
            return rng.choice(["", "isbn ", "invoice "]), None, f"{digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"
        if form == 12:
            return "", None, f"{digits(3)} {digits(3)} {digits(3)}"
        return "", None, f"{word()}-{word()}-{word()}-{digits(2)}-{word()}"

    out = []
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(rng.randint(2, 6))) + " ", []
        for _ in range(rng.randint(1, 2)):
            if (form := rng.random()) < 0.35:
                parts = neighbours() if form < 0.08 else numbers() if form < 0.12 else published() if form < 0.25 else opaque()
            else:
                lead, kind, body = entity()
                parts = [(lead, None), (body, kind), ('" ' if lead.endswith('"') else "' " if lead.endswith("'") else " ", None)]
            for body, kind in parts:
                if kind:
                    gold.append((len(text), len(text) + len(body), kind))
                text += body
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
        out.append((text, gold))
    return out


def train(n: int = 5000, seed: int = 5, rounds: int = 8) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional log-likelihood, with a small ridge."""
    places = []
    for text, gold in examples(n, seed):
        for start, end in places_of(text, base_spans(text)):
            tokens, segs = lattice(text, start, end)
            at = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j, _ in segs}
            inside = [(a, b, k) for a, b, k in gold if start <= a and b <= end]
            if lost := [text[a:b] for a, b, _ in inside if (a, b) not in at]:
                raise ValueError(f"no segments for {lost}")
            places.append((len(tokens), segs, {(*at[a, b], KINDS.index(k)) for a, b, k in inside}))
    weights: dict[str, float] = {}
    rng = random.Random(seed)
    for r in range(rounds):
        rng.shuffle(places)
        for n_tokens, segs, gold in places:
            for f, g in gradient(n_tokens, segs, gold, weights).items():
                weights[f] = weights.get(f, 0.0) * 0.9999 + 0.3 / (1 + r) * g
    return {k: round(v, 4) for k, v in sorted(weights.items()) if abs(v) >= 0.02}


@cache
def weights() -> dict[str, float]:
    """What :func:`train` gave, from the file beside this module."""
    return json.loads(resources.files(__package__).joinpath("pii_weights.json").read_text())


#: Scores of features under :func:`weights`.
_MEMO: dict[tuple[str, ...], list[float]] = {}


def added_spans(text: str, base: dict[str, list[Span]], model: dict[str, float] | None = None) -> list[tuple[str, int, int]]:
    """Entities of the field that meet no base span."""
    model, memo = (weights(), _MEMO) if model is None else (model, {})
    out = []
    for start, end in places_of(text, base):
        tokens = tokens_of(text, start, end)
        out += [(KINDS[k], tokens[i][0], tokens[j - 1][1]) for i, j, k in _best(len(tokens), _scored(segments(text, start, end, tokens), model, memo))]
    return out


def find(text: str | None) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """Base spans of a text by kind, and the spans that the field adds."""
    text = text or ""
    base = base_spans(text)
    return base, added_spans(text, base)


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    base, more = find(text)
    spans = sorted([(a, b, k) for k, v in base.items() for a, b in v] + [(a, b, k) for k, a, b in more])
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], f"[{k.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans; repeated rows are searched each; extra columns are ignored.
    """

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for text in cols["text"]:
            base, more = find(text)
            for k in BASE_KINDS:
                out[f"n_{k}"].append(len(base[k]))
            own = [(k, a, b) for k in BASE_KINDS for a, b in base[k]]
            out["base_sha256"].append(hashlib.sha256(listed(own).encode()).hexdigest())
            out["spans"].append(listed(own + more))
            out["n_added"].append(len(more))
        return {"doc_id": cols["doc_id"], **out}

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return arrow_map(docs.select("doc_id", "text"), run, schema)


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and n_chars counted anew; other columns stay, a null text stays null."""

    def run(cols: dict) -> dict:
        text = [mask(t) for t in cols["text"]]
        return {"text": text, "n_chars": [None if t is None else len(t) for t in text]}

    return arrow_replace(docs, ["text"], run)
