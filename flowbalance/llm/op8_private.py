"""PII: detected entities are replaced by keyed surrogates of their own type and format.

E-mail addresses, phone numbers, IPv4 addresses, payment card numbers, social security numbers, IBANs,
secrets (``token = "..."`` and the like, and keys of known prefixes) and names after a title are found in
whole texts. An entity's identity is its normal form (lower case, bare digits), so all its spellings get
one surrogate, written in the spelling's own format: punctuation, case (inner capitals too) and digit groups
stay, a card number that passes its checksum is replaced by one that passes, an IPv4 address keeps the lengths of
its numbers, an e-mail address keeps its top domain, and a name's surrogate has its script (Latin,
Cyrillic, Greek or Han; names in other scripts get Latin ones) and the gender of its title. Parts of a name are
entities of their own, so "Mr John Smith" and "Mr Smith" stay one family.

Within a document a name is one entity whatever its title: it takes the gender of the first title that
has one, and mentions without a title, spelled like a titled one, are replaced as well. In Han texts,
which have no spaces, such mentions are found only where no letter adjoins.

Surrogates are drawn by a keyed hash. Over all distinct entities of the corpus it is then checked that no
two share a surrogate (given names and surnames count as one kind) and that none is a real entity; those that
fail draw again until none fails. Later draws have longer forms, texts from the fourth on and numbers from the
ninth on, so that a form of which too many are in use comes to an end. Entities on other than their first
draw are few; up to ``MOST_REDRAWN`` of them are counted and broadcast, more are joined to their texts.

Defined results: a null text stays null and has no entities, an empty text stays empty. Overlapping
finds go to the earlier, then the longer one. Repeated rows are replaced alike. An empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbalance.llm.common import cut

_LOCAL = re.compile(r"[\w.%+\-]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w\-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}")
_NUMBER = re.compile(r"[+(]?\d[\d().\- ]*\d")
_NUMBERS = [
    ("ip", re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")),
    ("card", re.compile(r"\d{13,19}(?!\d)|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\d)|\d{4}([ -])\d{6}\2\d{5}(?!\d)")),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}(?!-?\d)")),
    ("phone", re.compile(r"\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{2,5}(?:[ .\-]?\d{2,5}){1,4}(?!\d)|\(\d{2,5}\)[ .\-]?\d{2,5}(?:[ .\-]\d{2,5}){1,3}(?!\d)|\d{3}([ .\-])\d{3}\1\d{4}(?!\d)")),
]
_SECRET = re.compile(r"""\b(?:token|secret|passw(?:or)?d|pwd|api[_\- ]?key|access[_\- ]?key|auth(?:orization)?)["']?\s*[:=]\s*["']?([^\s"']{8,})""", re.I)
_SECRET_HINT = re.compile(r"[:=]")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxa-", "xoxb-", "xoxp-")
_PREFIXED = re.compile(rf"\b(?:{'|'.join(_PREFIXES)})[A-Za-z0-9_\-]{{12,}}")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_IBAN_HINT = re.compile(r"[A-Z]{2}\d\d")
#: Titles that announce a name, by gender.
TITLES = {"m": ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин"],
          "f": ["Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Г-жа", "Госпожа"],
          "n": ["Dr", "Prof"]}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: A word of a name: no lower-case letter of a cased script first, apostrophes within.
_NAMED = r"[^\W\d_a-zà-öø-ÿа-яёα-ωάέήίόύώ](?:['’]?[^\W\d_])+"
_NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(_GENDER, key=len, reverse=True))})\.?[  ]({_NAMED}(?:[  -]{_NAMED}){{0,2}})(?!\w)")
_PART = re.compile(r"[^\W\d_](?:['’]?[^\W\d_])*")
_POSSESSIVE = re.compile(r"['’]s?\Z")
#: Syllables of made-up names by script, and how given names end by gender.
SYLLABLES = {"latin": ("bdfgklmnprstv", "aeiou"), "cyrillic": ("бвгдклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστ", "αειου")}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("latin", "n"): "i", ("cyrillic", "m"): "н", ("cyrillic", "f"): "а", ("cyrillic", "n"): "и",
           ("greek", "m"): "ν", ("greek", "f"): "α", ("greek", "n"): "ι", ("han", "m"): "强军勇伟", ("han", "f"): "丽芳娜英", ("han", "n"): "文华"}
HAN = "安白方高何林马宋唐吴杨张"
_SCRIPTS = {"cyrillic": re.compile("[а-яё]"), "greek": re.compile("[α-ωάέήίόύώ]"), "han": re.compile("[\u4e00-\u9fff]")}

#: Draws after which a form becomes longer, or an IPv4 address gives up the lengths of its numbers.
TEXTS_GROW, NUMBERS_GROW = 2, 7

#: Entities on other than their first draw that are broadcast, about 20 MB.
MOST_REDRAWN = 200_000
FOUND = "array<struct<kind: string, start: int, surrogate: string>>"


def _luhn(digits: str) -> int:
    """Sum that a valid number has divisible by ten."""
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Every mention of the names that a title announces somewhere in the text."""
    kinds: dict[str, str] = {}
    spelled: dict[str, str] = {}
    for m in _NAME.finditer(text):
        parts = [_POSSESSIVE.sub("", p.group()) for p in _PART.finditer(m.group(2))]
        for k, part in enumerate(parts):
            norm = re.sub(r"\W", "", part.casefold())
            kind = "name" + (_GENDER[m.group(1)] if k < len(parts) - 1 else "")
            spelled[part] = norm
            if kinds.get(norm, "name") == "name" or (kinds[norm] == "namen" and kind in ("namem", "namef")):
                kinds[norm] = kind
    if not spelled:
        return []
    found = []
    for m in _PART.finditer(text):
        whole, heads = m.group(), re.split("['’]", m.group())
        for mention in (whole, "'".join(heads[:-1]), "’".join(heads[:-1]), heads[0]):
            if mention in spelled:
                norm = spelled[mention]
                found.append((m.start(), m.start() + len(mention), kinds[norm], norm))
                break
    return found


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of every entity, in order, without overlap."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text[max(0, at - 64):at]), _DOMAIN.match(text, at + 1)
        if left and right:
            local = left.group().lstrip(".-%")
            if local:
                found.append((at - len(local), right.end(), "email", (local + "@" + right.group()).lower()))
        at = text.find("@", at + 1)
    for run in _NUMBER.finditer(text):
        if run.end() - run.start() < 7:
            continue
        s = run.start()
        while s < run.end():
            for kind, pattern in _NUMBERS:
                m = pattern.match(text, s)
                if m and not (s and (text[s - 1].isalnum() or text[s - 1] in "._")) and not text[m.end():m.end() + 1].isalpha():
                    found.append((s, m.end(), kind, m.group() if kind == "ip" else re.sub(r"\D", "", m.group())))
                    s = m.end()
                    break
            else:
                s += 1
    if _SECRET_HINT.search(text):
        found += [(m.start(1), m.end(1), "secret", m.group(1).lower()) for m in _SECRET.finditer(text)]
    if any(p in text for p in _PREFIXES):
        found += [(*m.span(), "secret", m.group().lower()) for m in _PREFIXED.finditer(text)]
    if _IBAN_HINT.search(text):
        found += [(*m.span(), "iban", m.group().replace(" ", "")) for m in _IBAN.finditer(text) if sum(c.isdigit() for c in m.group()) >= 10]
    if any(t in text for t in _GENDER):
        found += _names(text)
    found.sort(key=lambda e: (e[0], -e[1]))
    kept, end = [], 0
    for e in found:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


def surrogate(kind: str, norm: str, attempt: int, key: str) -> str:
    """Normal form of the surrogate, of the length of the entity's (longer on late attempts)."""
    stream = iter(hashlib.shake_256(f"{key}\0{kind}\0{norm}\0{attempt}".encode()).digest(8 * len(norm) + 256 + 32 * attempt))
    longer, digits = max(0, attempt - TEXTS_GROW), max(0, attempt - NUMBERS_GROW)

    def pick(choices: str) -> str:
        return choices[(next(stream) << 16 | next(stream) << 8 | next(stream)) % len(choices)]

    def like(c: str) -> str:
        if c.isdigit():
            return pick("0123456789")
        return pick("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c

    if kind == "email":
        local, _, domain = norm.rpartition("@")
        *labels, top = domain.split(".")
        named = [x if x == "example" else "".join(map(like, x)) for x in labels]
        more = "".join(like("a") for _ in range(longer))
        return "".join(map(like, local)) + more + "@" + ".".join([*named, top])
    if kind == "ip":
        if digits > 4:  # so many addresses are in use that only the wider form has room
            return "fd" + ":".join(f"{next(stream):02x}{next(stream):02x}"[2 * (k == 0):] for k in range(8))
        sizes = [(1, 9), (10, 90), (100, 155)]
        lows = [sizes[len(part) - 1] if longer == 0 else (1, 254) for part in norm.split(".")]
        return ".".join(str(low + (next(stream) << 8 | next(stream)) % n) for low, n in lows)
    if kind == "secret":
        is_hex = all(c in "0123456789abcdef" for c in norm)
        return "".join(pick("0123456789abcdef") if is_hex else like(c) for c in norm) + "".join(like("a") for _ in range(longer))
    if kind == "card":
        body = norm[0] + "".join(map(like, norm[1:-1] + "0" * digits))
        fit = (10 - _luhn(body + "0")) % 10
        return body + str(fit if _luhn(norm) % 10 == 0 else (fit + 1 + int(pick("012345678"))) % 10)
    if kind == "iban":
        body = "".join(like(c).upper() for c in norm[4:] + "0" * digits)
        value = int("".join(str(int(c, 36)) for c in body + norm[:2] + "00"))
        return f"{norm[:2]}{98 - value % 97:02d}{body}"
    if kind.startswith("name"):
        script = next((name for name, letters in _SCRIPTS.items() if letters.search(norm)), "latin")
        if script == "han":
            return "".join(pick(HAN) for _ in range(len(norm) - 1 + attempt // 2)) + pick(ENDINGS.get((script, kind[4:]), HAN))
        a, b = SYLLABLES[script]
        stem = "".join(pick(a) + pick(b) for _ in range(3 + attempt // 2))
        return stem + ENDINGS.get((script, kind[4:]), pick(a))
    code = len(norm) - 10 if kind == "phone" and len(norm) > 10 else 0  # a country code stays
    return norm[:code] + "".join(map(like, norm[code:] + "0" * digits))  # phone, ssn


def written(kind: str, spelling: str, norm: str, drawn: str) -> str:
    """The surrogate's normal form in the spelling of the entity."""
    if kind in ("card", "ssn", "phone", "iban"):
        out, k = [], 0
        for c in spelling:
            if c.isalnum():
                out.append(drawn[k])
                k += 1
            else:
                out.append(c)
        return "".join(out) + drawn[k:]
    if kind.startswith("name"):
        letters = [c for c in spelling if c.isalpha()]
        new = drawn.upper() if spelling.isupper() and len(letters) > 1 else "".join(
            d.upper() if k == 0 or k < len(letters) and letters[k].isupper() else d for k, d in enumerate(drawn))
        for k, c in enumerate(spelling):
            if not c.isalpha() and k < len(new):
                new = new[:k] + c + new[k:]
        return new
    if spelling.lower() == spelling:
        return drawn
    if spelling.upper() == spelling:
        return drawn.upper()
    return "".join(d.upper() if k < len(spelling) and spelling[k].isupper() else d for k, d in enumerate(drawn))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {e[2:] for text in batch["text"] for e in entities(text.as_py() or "")}
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in seen], pa.string()), pa.array([e[1] for e in seen], pa.string())], names=["kind", "norm"])


def _draws(key: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [surrogate(k, n, a, key) for k, n, a in zip(*(batch[c].to_pylist() for c in ("kind", "norm", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["norm"], batch["attempt"], pa.array(drawn, pa.string())], names=["kind", "norm", "attempt", "drawn"])

    return rows


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {(d, *e[2:]) for d, text in zip(batch["same"].to_pylist(), batch["text"], strict=True) for e in entities(text.as_py() or "")}
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in seen], pa.int64()), *(pa.array([e[k] for e in seen], pa.string()) for k in (1, 2))], names=["same", "kind", "norm"])


def _replace(key: str, redrawn):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = redrawn.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, founds = [], []
                for text, again in zip(part["text"], part["again"], strict=True):
                    text, found, out, at, size = text.as_py(), [], [], 0, 0
                    draws = {(x["kind"], x["norm"]): x["attempt"] for x in again.as_py() or ()}
                    for start, end, kind, norm in entities(text or ""):
                        new = written(kind, text[start:end], norm, surrogate(kind, norm, draws.get((kind, norm), everywhere.get((kind, norm), 0)), key))
                        out += [text[at:start], new]
                        size += start - at
                        found.append({"kind": kind, "start": size, "surrogate": new})
                        size += len(new)
                        at = end
                    texts.append("".join([*out, text[at:]]) if out else text)
                    founds.append(found)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("surrogate", pa.string())]))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string()), pa.array([len(f) for f in founds], pa.int32()), pa.array(founds, kind)], names=["doc_id", "text", "n_entities", "found"])

    return rows


def draws(docs: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of all distinct entities, so that their surrogates are distinct and none
    is a real entity."""
    real = cut(docs.select("text").where("text is not null").mapInArrow(_distinct, "kind string, norm string").distinct())
    family = F.expr("IF(kind LIKE 'name%', 'name', kind)")
    known = real.select(family.alias("family"), F.col("norm").alias("drawn"), F.lit(True).alias("is_real")).distinct()
    state = real.withColumn("attempt", F.lit(0))
    while True:
        drawn = state.mapInArrow(_draws(key), "kind string, norm string, attempt int, drawn string").withColumn("family", family)
        first = drawn.groupBy("family", "drawn").agg(F.min(F.struct("norm", "kind")).alias("keeps"))
        checked = cut(drawn.join(first, ["family", "drawn"]).join(known, ["family", "drawn"], "left").select(
            "kind", "norm", "attempt", (F.col("is_real").isNotNull() | (F.struct("norm", "kind") != F.col("keeps"))).alias("again")))
        state = checked.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
        if checked.where("again").isEmpty():
            return state


def replace_private(docs: DataFrame, key: str, most_redrawn: int = MOST_REDRAWN) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, text with surrogates, n_entities, found (kind, start in
    the new text, surrogate)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = cut(draws(rows, key).where("attempt > 0"))
    few = again.limit(most_redrawn + 1).collect()
    everywhere: dict[tuple[str, str], int] = {}
    if len(few) <= most_redrawn:
        everywhere = {(x["kind"], x["norm"]): x["attempt"] for x in few}
        rows = rows.withColumn("again", F.lit(None).cast("array<struct<kind: string, norm: string, attempt: int>>"))
    else:
        # by text and not by id: ids may be missing or repeat, equal texts have equal entities
        keyed = rows.withColumn("same", F.xxhash64("text"))
        places = keyed.mapInArrow(_places, "same long, kind string, norm string").distinct()
        marks = places.join(again, ["kind", "norm"]).groupBy("same").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("again"))
        rows = keyed.join(marks, "same", "left").select("doc_id", "text", "again")
    shared = docs.sparkSession.sparkContext.broadcast(everywhere)
    return rows.mapInArrow(_replace(key, shared), f"doc_id long, text string, n_entities int, found {FOUND}")
