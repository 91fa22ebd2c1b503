"""Personal data: keyed, type-consistent surrogates.

Mail addresses, phone numbers, network addresses, card, account and social security numbers, and names behind a form of
address are replaced, these names also wherever else in their text they stand. A surrogate comes from HMAC-SHA256 of a secret key, the kind and the normal form of the entity, and follows its
format: digits and punctuation where the original has them, a valid check digit, the same script, letter case and gender.
Equal entities get equal surrogates everywhere. Distinct entities get distinct ones: the table of entities is checked for
collisions, also with values that really occur, and colliding entries are drawn again until none is left.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from meshspark.llm.shared import keep, query, read

ROUNDS = 40
MENTION = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                    T.StructField("kind", T.StringType()), T.StructField("canon", T.StringType())]))
_ARROW_MENTION = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("canon", pa.string())]))

# Forms of address by gender, per script; surrogate syllables per script.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "г-жа", "κα")
MALE = ("Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Signor", "г-н", "κ")
NEUTRAL = ("Dr", "Prof")
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fa", "fe", "ga", "ho", "ja", "ka", "ke", "la", "li", "ma", "me", "na", "no", "pa", "ra", "ri",
              "sa", "so", "ta", "ti", "va", "vo", "wa", "ze", "za", "lo", "mi", "ne"),
    "cyrillic": ("ба", "ве", "га", "до", "жа", "зо", "ки", "ла", "ма", "ни", "по", "ра", "са", "то", "фе", "ша"),
    "greek": ("βα", "γε", "δα", "ζο", "θα", "κι", "λα", "μα", "νι", "πο", "ρα", "σα", "το", "φε", "χα", "ξα"),
}
ENDINGS = {("latin", "female"): ("na", "la", "ra"), ("latin", "male"): ("ron", "dan", "vin"), ("latin", "neutral"): ("ley", "ker", "man"),
           ("cyrillic", "female"): ("на", "ра", "ла"), ("cyrillic", "male"): ("ров", "дин", "вич"), ("cyrillic", "neutral"): ("ко", "ук", "ич"),
           ("greek", "female"): ("να", "ρα", "λα"), ("greek", "male"): ("νος", "ρης", "λος"), ("greek", "neutral"): ("ου", "ακη", "ιδη")}

_UPPER = "A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿĀ-žΆ-ώА-яЁё"
_PATTERNS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)", re.ASCII)),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,}(?![\w-])", re.ASCII)),
    ("ssn", re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])", re.ASCII)),
    ("phone", re.compile(r"(?<![\w.+-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{4}"
                         r"|\+1(?:[ .()-]{0,3}\d){10}|\+[2-9](?:[ .()-]{0,3}\d){7,14}"
                         r"|0[1-9]\d{8,9}|0[1-9](?P<gap>[ .-])\d\d(?:(?P=gap)\d\d){3})(?![\w-])", re.ASCII)),
)
_NAME = re.compile(rf"(?<!\w)(?P<form>{'|'.join(map(re.escape, FEMALE + MALE + NEUTRAL))})\.? (?P<name>[{_UPPER}][{_LETTER}'’-]+(?: [{_UPPER}][{_LETTER}'’-]+){{0,2}})")
_WORD = re.compile(rf"[{_LETTER}]+")
_WHOLE_WORD = re.compile(rf"(?<!\w)[{_LETTER}]{{2,}}(?!\w)")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _card(digits: str) -> bool:
    """A card number by issuer range, length and check digit."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    issuer = (digits[0] == "4" and n in (13, 16, 19)) or ((51 <= two <= 55 or 2221 <= four <= 2720) and n == 16) \
        or (two in (34, 37) and n == 15) or ((four == 6011 or two == 65) and n in (16, 19))
    return issuer and _luhn(digits)


def _iban(plain: str) -> bool:
    moved = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _edges(raw: str) -> list[int]:
    """Where the parts of a run end and begin: its ends and both sides of each blank or dash."""
    return [0, *[x for i, c in enumerate(raw) if c in " -" for x in (i, i + 1)], len(raw)]


def _parts(raw: str, kind: str) -> list[tuple[int, int]]:
    """Valid numbers inside a run of characters, from the left, the longest at each start; none begins or ends inside a group."""
    edges, at, out = _edges(raw), 0, []
    for a in edges[::2]:
        if a < at:
            continue
        for b in reversed([b for b in edges[bisect.bisect(edges, a) | 1::2][:34] if b - a <= 67]):
            plain = raw[a:b].replace(" ", "").replace("-", "")
            if 13 <= len(plain) <= 19 and _card(plain) if kind == "card" else 12 <= len(plain) <= 34 and _iban(plain):
                out.append((a, b))
                at = b
                break
    return out


def _script(word: str) -> str:
    return "cyrillic" if re.search("[А-яЁё]", word) else "greek" if re.search("[Ά-ώ]", word) else "latin"


def _spans(kind: str, pattern: re.Pattern, text: str):
    """Places of the matches; of runs of digits or groups, the valid numbers inside. The search goes on behind an accepted part."""
    at = 0
    while m := pattern.search(text, at):
        if kind not in ("card", "iban"):
            yield m.span()
            at = m.end()
            continue
        parts = _parts(m[0], kind)
        yield from ((m.start() + a, m.start() + b) for a, b in parts)
        at = m.start() + parts[-1][1] if parts else m.end() if kind == "card" else m.start() + 4


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions (start, end, kind, normal form), not overlapping, by start. Names are split into words, so that a surname
    alone and a full name agree on it; a capitalised word that is part of such a name is a mention everywhere in the text."""
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def add(start, end, kind, canon):
        i = bisect.bisect_left(taken, (end, 0))
        if i and taken[i - 1][1] > start:
            return False
        found.append((start, end, kind, canon))
        return True

    for kind, pattern in _PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        new = []
        for start, end in _spans(kind, pattern, text):
            raw = text[start:end]
            digits = "".join(c for c in raw if c.isdigit())
            if kind == "email":
                canon = raw.lower()
            elif kind == "ip":
                canon = ".".join(str(int(x)) for x in raw.split("."))
            elif kind == "iban":
                canon = raw.replace(" ", "")
            elif kind == "card":
                canon = digits
            elif kind == "phone":
                canon = digits[1:] if len(digits) == 11 and digits[0] == "1" else "+" * (raw[0] == "+") + digits
                if not 7 <= len(digits) <= 15 or (raw[0] not in "+(" and len(digits) < 10):
                    continue
            else:
                canon = digits
            if add(start, end, kind, canon):
                new.append((start, end))
        taken = sorted(taken + new) if new else taken
    names: dict[str, str] = {}
    places = set()
    for m in _NAME.finditer(text):
        gender = "female" if m["form"] in FEMALE else "male" if m["form"] in MALE else "neutral"
        words = list(_WORD.finditer(m["name"]))
        for i, w in enumerate(words):
            role = "surname" if i == len(words) - 1 else gender
            start, kind, canon = m.start("name") + w.start(), f"name/{role}/{_script(w[0])}", w[0].lower()
            if add(start, start + len(w[0]), kind, canon):
                places.add(start)
                names.setdefault(canon, kind)
    for w in _WHOLE_WORD.finditer(text) if names else ():
        canon = w[0].lower()
        if canon in names and w[0][0].isupper() and w.start() not in places:
            add(w.start(), w.end(), names[canon], canon)
    return sorted(found)


class _Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.seed, self.n, self.pool = (key, "\x00".join(parts).encode()), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.seed[0], self.seed[1] + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """Normal form of the replacement; ``canon`` decides length, issuer, country and script."""
    s = _Stream(key, kind, canon, str(attempt))
    digit = lambda: str(s.below(10))
    if kind == "email":
        local, domain = canon.split("@")
        host = _Stream(key, "domain", domain)
        letters = lambda st, n: "".join(SYLLABLES["latin"][st.below(32)] for _ in range(n))
        body = "".join(digit() if c.isdigit() else c if not c.isalpha() else "" for c in local)
        return f"{letters(s, 4 + attempt // 8)}{body}@{letters(host, 4)}.example.{('com', 'org', 'net')[host.below(3)]}"
    if kind == "ip":
        return f"10.{s.below(256)}.{s.below(256)}.{s.below(256)}"
    if kind == "card":
        body = canon[:1] + "".join(digit() for _ in canon[1:-1])
        return next(body + c for c in "0123456789" if _luhn(body + c))
    if kind == "iban":
        body = "".join(digit() if c.isdigit() else chr(65 + s.below(26)) for c in canon[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}"
    if kind == "ssn":
        return "9" + "".join(digit() for _ in canon[1:])
    if kind == "phone":
        if len(canon) == 10 and canon[0] not in "+0":
            return f"{2 + s.below(8)}" + "".join(digit() for _ in range(9))
        keep_ = max(3 * (canon[0] == "+"), len(canon) - 9, 0)
        return canon[:keep_] + "".join(digit() for _ in canon[keep_:])
    _, role, script = kind.split("/")
    syllables = SYLLABLES[script]
    stem = "".join(syllables[s.below(len(syllables))] for _ in range(2 + min(2, len(canon) // 7) + attempt // 4))
    ends = ENDINGS[script, "neutral" if role == "surname" else role]
    return stem + ends[s.below(len(ends))]


def write_like(original: str, kind: str, canon: str, new: str) -> str:
    """The surrogate in the format of one mention: its punctuation, prefix and letter case."""
    if kind.startswith("name/"):
        return new.upper() if original.isupper() and len(original) > 1 else new[0].upper() + new[1:] if original[0].isupper() else new
    if kind == "email":
        return new.upper() if original.isupper() else new
    if kind == "ip":
        return new
    if kind == "phone":
        new = new.removeprefix("+")
    if kind == "phone" and sum(c.isdigit() for c in original) == len(new) + 1:
        new = "1" + new
    fill = iter(new)
    return "".join(next(fill) if c.isalnum() else c for c in original)


def _detected(batches):
    for b in batches:
        kept = [i for i, c in enumerate(b.schema.names) if c != "_mentions"]
        found = [[{"start": s, "end": e, "kind": k, "canon": c} for s, e, k, c in detect(t.as_py() or "")] for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(found, _ARROW_MENTION)],
                                         names=[*[b.schema.names[i] for i in kept], "_mentions"])


def mentions(docs: DataFrame) -> DataFrame:
    """docs plus ``_mentions``; every text is read whole, null texts have none. No shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_mentions", MENTION)])
    return docs.mapInArrow(_detected, schema)


def _drawn(key: bytes):
    def run(batches):
        for b in batches:
            out = [surrogate(key, k, c, a) for k, c, a in zip(*[b.column(n).to_pylist() for n in ("kind", "canon", "attempt")])]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("kind", "canon", "attempt")], pa.array(out, pa.string())],
                                             names=["kind", "canon", "attempt", "surrogate"])
    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon): distinct per kind and never a value that occurs.

    A round draws for all open entities, keeps those whose surrogate nobody has, the smallest normal form first, and opens the others
    again. The result depends on the set of entities and the key alone.
    """
    entities = keep(entities, "entities")
    opened = entities.withColumn("attempt", F.lit(0))
    done = None
    for attempt in range(ROUNDS):
        drawn = keep(opened.mapInArrow(_drawn(key), "kind string, canon string, attempt int, surrogate string"), "surrogates")
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canon"))
        real = entities.select("kind", F.col("canon").alias("surrogate"))
        free = drawn.withColumn("_n", first).filter("_n = 1").drop("_n").join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "surrogate"], "left_anti")
        free = keep(free.select("kind", "canon", "surrogate"), "assigned")
        done = free if done is None else done.unionByName(free)
        rest = drawn.join(free, ["kind", "canon"], "left_anti").select("kind", "canon", F.lit(attempt + 1).alias("attempt"))
        opened = keep(rest, "open-entities")
        if opened.isEmpty():
            return done
    raise ValueError(f"entities without a free surrogate after {ROUNDS} rounds: the format has too few values")


def _applied(batches):
    for b in batches:
        texts = []
        for text, repl in zip(b.column("text").to_pylist(), b.column("_repl").to_pylist()):
            parts, at = [], 0
            for r in sorted(repl, key=lambda r: r["start"]):
                parts += [text[at:r["start"]], write_like(text[r["start"]:r["end"]], r["kind"], r["canon"], r["surrogate"])]
                at = r["end"]
            texts.append("".join(parts) + text[at:])
        names = [c for c in b.schema.names if c != "_repl"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names=names)


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """All rows of docs with surrogates in ``text``, plus n_entities (mentions replaced) and kinds (their kinds in order).

    Texts without a mention, null and empty ones included, come back unchanged; equal rows stay equal; an empty table gives an empty one;
    input columns of the two names are replaced. Only rows with mentions are shuffled, by a row number; texts of the others never move.
    """
    d = docs.drop("n_entities", "kinds", "_mentions", "_row", "_repl")
    seen = mentions(d)
    counted = [F.size("_mentions").cast("long").alias("n_entities"), F.transform("_mentions", lambda m: m.kind).alias("kinds")]
    clean = seen.filter(F.size("_mentions") == 0).select(*d.columns, *counted)
    found = keep(seen.filter(F.size("_mentions") > 0).withColumn("_row", F.monotonically_increasing_id()), "mentions")
    each = found.select("_row", F.explode("_mentions").alias("m")).select("_row", "m.*")
    given = assign(each.select("kind", "canon").distinct(), key)
    repl = each.join(given, ["kind", "canon"]).groupBy("_row").agg(
        F.collect_list(F.struct("start", "end", "kind", "canon", "surrogate")).alias("_repl"))
    dirty = found.select(*d.columns, *counted, "_row").join(repl, "_row").drop("_row")
    schema = T.StructType([f for f in dirty.schema.fields if f.name != "_repl"])
    return clean.unionByName(dirty.mapInArrow(_applied, schema))


@query("op10_pii_surrogates")
def op10_pii_surrogates(spark, sf_dir):
    return replace(read(spark, sf_dir, "documents").select("doc_id", "text"), b"surrogates of this corpus")
