"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Found values are validated first (issuer and Luhn, area rules, mod 97, the calendar, octets); a value that does not
validate stays.
Phone numbers are told by their written form alone, as area codes that are not in use are written down, too.
A valid one is permuted inside its own format: digits stay digits, separators stay, and the result validates again
(cycle walking), so card numbers of an issuer remain such numbers and dates remain dates. The permutation depends on the
key and the kind of value only: equal values get equal pseudonyms in all documents, a day has one pseudonym in all
notations, and the key's owner can invert them. Dates keep the width of their day and month, and days above 12 stay
above it, so that a notation is read as before.

Secrets (access keys, tokens, passwords) and the names in e-mail addresses are permuted in the same way; domains stay.

The key is the session's ``spark.cachefold.pii.key``. Without one, a random key is drawn for the application, which links
values within that run and is then lost.

Defined cases: a null text stays null with 0 findings; an empty text stays empty; very long texts are searched whole.
Rows are handled one by one, so repeated rows, null ids and empty tables need no rule. Other columns pass through,
whatever their names; an input column of the name asked for the count (``n_pii``) is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The configured key, or one drawn at random for the application."""
    if told := spark.conf.get("spark.cachefold.pii.key", None):
        return told.encode()
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def _value(digits: tuple[int, ...], radix: int) -> int:
    out = 0
    for d in digits:
        out = out * radix + d
    return out


def _digits(value: int, radix: int, n: int) -> tuple[int, ...]:
    out = [0] * n
    for i in range(n - 1, -1, -1):
        value, out[i] = divmod(value, radix)
    return tuple(out)


def _round(key: bytes, tweak: str, i: int, half: tuple[int, ...]) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{half}".encode(), key=key[:64], digest_size=24).digest(), "big")


def permute(digits: tuple[int, ...], radix: int, key: bytes, tweak: str, invert: bool = False) -> tuple[int, ...]:
    """A keyed permutation of the digit strings of this length: an unbalanced Feistel network."""
    n = len(digits)
    sizes = (n // 2, n - n // 2)
    a, b = digits[: sizes[0]], digits[sizes[0] :]
    if invert and ROUNDS % 2:
        a, b = digits[: sizes[1]], digits[sizes[1] :]
    for i in reversed(range(ROUNDS)) if invert else range(ROUNDS):
        m = sizes[i % 2]
        if invert:
            a, b = _digits((_value(b, radix) - _round(key, tweak, i, a)) % radix**m, radix, m), a
        else:
            a, b = b, _digits((_value(a, radix) + _round(key, tweak, i, b)) % radix**m, radix, m)
    return a + b


def walk(digits: tuple[int, ...], radix: int, key: bytes, tweak: str, valid: Callable[[tuple[int, ...]], bool], invert: bool = False) -> tuple[int, ...]:
    """The permutation restricted to valid strings: it is repeated until the result is valid."""
    digits = permute(digits, radix, key, tweak, invert)
    while not valid(digits):
        digits = permute(digits, radix, key, tweak, invert)
    return digits


def _laid(text: str, digits: tuple[int, ...]) -> str:
    """``digits`` in the places of the text's digits."""
    left = iter(digits)
    return "".join(str(next(left)) if c.isdigit() else c for c in text)


def _of(text: str) -> tuple[int, ...]:
    return tuple(int(c) for c in text if c.isdigit())


def luhn(digits: tuple[int, ...]) -> bool:
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


#: How the numbers of card issuers begin, and how long they are.
ISSUERS = (
    ("4", (13, 16, 19)), ("5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720", (16,)), ("3[47]", (15,)), ("6011|64[4-9]|65", (16, 17, 18, 19)),
    ("30[0-5]|3[689]", (14, 15, 16, 17, 18, 19)), ("352[89]|35[3-8]", (16, 17, 18, 19)), ("62", (16, 17, 18, 19)),
)
_ISSUERS = [(re.compile(begin), lengths) for begin, lengths in ISSUERS]


def issuer(digits: tuple[int, ...], length: int) -> int | None:
    text = "".join(map(str, digits))
    return next((i for i, (begin, lengths) in enumerate(_ISSUERS) if length in lengths and begin.match(text)), None)


def _card(text: str, key: bytes) -> str | None:
    digits = _of(text)
    mine = issuer(digits, len(digits))
    if mine is None or not luhn(digits):
        return None
    head, body = digits[:1], digits[1:-1]
    body = walk(body, 10, key, f"card{len(digits)}{head[0]}", lambda d: issuer(head + d, len(digits)) == mine)
    return _laid(text, head + body + next((c,) for c in range(10) if luhn((*head, *body, c))))


def _nanp(d: tuple[int, ...]) -> bool:
    return d[0] > 1 and d[3] > 1


def _phone(text: str, key: bytes) -> str | None:
    digits = _of(text)
    head, national = digits[:-10], digits[-10:]
    # Numbers by the plan and others are permuted among themselves.
    planned = _nanp(national)
    return _laid(text, head + walk(national, 10, key, "phone", lambda d: _nanp(d) == planned))


def _abroad(text: str, key: bytes) -> str | None:
    digits = _of(text)
    return _laid(text, digits[:2] + permute(digits[2:], 10, key, f"abroad{digits[:2]}")) if 9 <= len(digits) <= 15 else None


def _ssn_rule(d: tuple[int, ...]) -> bool:
    area, group, serial = _value(d[:3], 10), _value(d[3:5], 10), _value(d[5:], 10)
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _ssn(text: str, key: bytes) -> str | None:
    return _laid(text, walk(_of(text), 10, key, "ssn", _ssn_rule)) if _ssn_rule(_of(text)) else None


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = by_class(plain[4:], key, f"iban{plain[:2]}", hexadecimal=False)
    new = iter(f"{plain[:2]}{98 - _mod97(plain[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    return ".".join(map(str, permute(tuple(octets), 256, key, "ip")))


#: The forms of dates, with the order of their parts.
DATE_FORMS = ((r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", "ymd"), (r"\d{1,2}[-/.]\d{1,2}[-/.]\d{4}", "dmy"), (r"\d{1,2}[-/.]\d{1,2}[-/.]\d{4}", "mdy"))


def _date(text: str, key: bytes) -> str | None:
    numbers = re.split(r"[-/.]", text)
    marks = re.findall(r"[-/.]", text)
    if marks[0] != marks[1]:
        return None
    for form, order in DATE_FORMS:
        if not re.fullmatch(form, text):
            continue
        part = dict(zip(order, map(int, numbers), strict=True))
        try:
            day = datetime.date(part["y"], part["m"], part["d"]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None

        def of(bits: tuple[int, ...]) -> datetime.date | None:
            at = FIRST_DAY + _value(bits, 2)
            return datetime.date.fromordinal(at) if at <= LAST_DAY else None

        sort = _date_class(datetime.date.fromordinal(day))
        fits = lambda bits, sort=sort: (d := of(bits)) is not None and _date_class(d) == sort
        new = of(walk(_digits(day - FIRST_DAY, 2, 17), 2, key, "date", fits))
        value = {"y": str(new.year), "m": str(new.month), "d": str(new.day)}
        return marks[0].join(value[k].rjust(len(n), "0") for k, n in zip(order, numbers, strict=True))
    return None


def _date_class(day: datetime.date) -> tuple[int, bool]:
    """What a pseudonym shares with its date, so that widths stay and no other order of the parts is read."""
    return (day.day >= 10) + (day.day > 12), day.month >= 10


#: The characters of an IBAN by its country.
_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTHS = {country: n for n, countries in _COUNTRIES.items() for country in countries.split()}

_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = "0123456789abcdef"


def by_class(text: str, key: bytes, tweak: str, hexadecimal: bool = True) -> str:
    """Digits, small and capital letters permuted among themselves; lower-case hexadecimal strings as such."""
    classes = (_HEX,) if hexadecimal and len(text) >= 16 and re.fullmatch("[0-9a-f]+", text) else _CLASSES
    out = list(text)
    for c in classes:
        at = [i for i, x in enumerate(out) if x in c]
        if at:
            rest = "".join("_" if x in c else x for x in out)
            new = permute(tuple(c.index(out[i]) for i in at), len(c), key, f"{tweak}|{c}|{rest}")
            for i, d in zip(at, new, strict=True):
                out[i] = c[d]
    return "".join(out)


def _email(text: str, key: bytes) -> str | None:
    name, _, domain = text.partition("@")
    return f"{by_class(name, key, f'email|{domain.lower()}')}@{domain}"


def _access_key(text: str, key: bytes) -> str | None:
    return text[:4] + by_class(text[4:], key, "access")


def _secret(text: str, key: bytes) -> str | None:
    name, mark, value = re.fullmatch(r"""(\w+)(\s*[=:]\s*["']?)(.+)""", text, re.DOTALL).groups()
    return f"{name}{mark}{by_class(value, key, 'secret')}"


#: Tried in this order at each place.
KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "secret": (r"""(?<!\w)(?i:password|passwd|token|secret|api_?key)\s*[=:]\s*["']?[A-Za-z0-9+/_.~-]{7,}[A-Za-z0-9+/_]""", _secret),
    "access": (r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", _access_key),
    "email": (r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "phone": (r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\w)", _phone),
    "abroad": (r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\d{2,4}){2,5}(?!\w)", _abroad),
    "card": (r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])", _card),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    "date": (r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\w/-])", _date),
    "ip": (r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", _ip),
}
_MAYBE = re.compile(r"[0-9@]|(?i:password|passwd|token|secret|api_?key)\s*[=:]")


def _one_pattern() -> re.Pattern[str]:
    """All kinds in one pattern; the numbered back references of each are moved to their place in the whole."""
    parts, groups = [], 0
    for name, (pattern, _) in KINDS.items():
        moved = re.sub(r"\\([1-9])", lambda m, g=groups: rf"(?:\{int(m[1]) + g + 1})", pattern)
        parts.append(f"(?P<{name}>{moved})")
        groups += 1 + re.compile(pattern).groups
    return re.compile("|".join(parts))


_PATTERN = _one_pattern()
_NAMES = list(KINDS)
_ALONE = {kind: re.compile(pattern) for kind, (pattern, _) in KINDS.items()}


def _ends(kind: str, text: str) -> list[int]:
    """Where a match may end: an IBAN that ran into the words behind it also before each of them, its country's length first."""
    if kind != "iban":
        return [len(text)]
    ends = [m.start() for m in re.finditer(" |$", text)]
    return sorted(ends, key=lambda e: (len(text[:e].replace(" ", "")) != IBAN_LENGTHS.get(text[:2]), -e))


def _validated(m: re.Match[str], key: bytes) -> tuple[int, str] | None:
    """The end and the pseudonym of the first kind that validates where ``m`` begins."""
    for kind in _NAMES[_NAMES.index(m.lastgroup) :]:
        own = m if kind == m.lastgroup else _ALONE[kind].match(m.string, m.start())
        for end in _ends(kind, own[0]) if own else ():
            new = KINDS[kind][1](own[0][:end], key)
            if new is not None:
                return own.start() + end, new
    return None


def pseudonymized(text: str, key: bytes) -> tuple[str, int]:
    """The text with its personal data permuted, and the number of values found."""
    if not _MAYBE.search(text):
        return text, 0
    out, done, at, found = [], 0, 0, 0
    while m := _PATTERN.search(text, at):
        # Behind a value that does not validate, the search goes on inside it.
        at = m.start() + 1
        if (hit := _validated(m, key)) is not None:
            out += [text[done : m.start()], hit[1]]
            done = at = hit[0]
            found += 1
    return "".join(out) + text[done:], found


def pseudonymize(docs: DataFrame, key: bytes | None = None, count: str = "n_pii") -> DataFrame:
    """``docs`` with its text pseudonymised, and ``count`` int (values found) behind its other columns."""
    key = session_key(docs.sparkSession) if key is None else key

    @F.pandas_udf("struct<text:string,n:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        pairs = [(None, 0) if t is None else pseudonymized(t, key) for t in texts]
        return pd.DataFrame(pairs, columns=["text", "n"]).astype({"n": "int32"})

    found = free_name(docs.columns, "found")
    done = docs.withColumn(found, run(F.col("text").cast("string")))
    kept = [F.col(f"{found}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() != count.lower()]
    return done.select(*kept, F.col(f"{found}.n").alias(count))
