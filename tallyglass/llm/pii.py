"""Personal data: validated values are replaced by keyed permutations of themselves within their format."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "card", "ssn", "ip", "date", "phone", "secret")
ROUNDS = 8
FIRST_DAY, DAYS = dt.date(1900, 1, 1), 73049  # up to 2099-12-31

# The shapes of values, tried in this order.
SHAPES = re.compile(r"""
  (?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))
| (?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?!\w))
| (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
| (?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<sep>[./])[0-9]{1,2}(?P=sep)[0-9]{4})(?:(?=T[0-9]{2}:?[0-9]{2})|(?![\w/-]|\.[0-9])))
| (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
| (?P<card>(?<![\w+.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
| (?P<phone>(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-])
    |(?<![\w+])\+[0-9]{8,15}(?!\w))
| (?P<secret>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:gh[pousr]_|sk[-_]|xox[abp]-)[A-Za-z0-9_-]{16,}
    |(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)["']?[ ]?[:=][ ]?["']?)[^\s"'<>,;]{6,})
""", re.VERBOSE)
# Each shape by itself, for places where an earlier kind matches but is not valid.
KIND_SHAPES = [(kind, re.compile(shape, re.VERBOSE)) for kind, shape in zip(
    ("email", "iban", "ip", "date", "ssn", "card", "phone", "secret"), re.split(r"\n\| ", SHAPES.pattern))]
# The lengths of IBANs by country; others are tried from the longest end to the shortest.
IBAN_LENGTHS = {c: int(n) for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL SV NI", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
# No value lacks all of these.
MAY_HOLD = re.compile(r"[0-9@=:]|sk|xox|AKIA|ASIA|gh[pousr]_").search
LETTERS, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
# Characters of a value that are permuted together; longer values go block by block.
BLOCK = 64
# Values longer than this are not remembered.
SHORT = 200
# A number of a version, not an address, stands behind these words.
VERSION = re.compile(r"(?i)\b(?:version|release|build|ver\.?|v\.?)[ ]?$")
# How a number without country code, area code in brackets or leading zero must be grouped to be taken for a phone.
NATIONAL = re.compile(r"[0-9]{3}([ .-])[0-9]{3}[ .-]?[0-9]{4}")
CODES = re.compile(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")


class Permutation:
    """A keyed bijection on 0 .. n-1 for any n: a balanced Feistel network over the next even number of bits, walked
    along its cycle until it lands on a wanted value again."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _step(self, value: int, half: int, tag: bytes) -> int:
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            message = b"%s|%d|%d|%d" % (tag, half, i, right)
            mixed = int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=max(8, (half + 7) // 8)).digest(), "big")
            left, right = right, left ^ (mixed & mask)
        return left << half | right

    def __call__(self, value: int, n: int, tag: str, wanted: Callable[[int], bool] = lambda _: True) -> int:
        """``value`` must itself be wanted; values are permuted among the wanted ones."""
        if n < 2:
            return value
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        label = f"{tag}|{n}".encode()
        while True:
            value = self._step(value, half, label)
            if value < n and wanted(value):
                return value


def _spread(value: int, radices: list[int]) -> list[int]:
    out = []
    for radix in reversed(radices):
        value, digit = divmod(value, radix)
        out.append(digit)
    return out[::-1]


def _gathered(digits: list[int], radices: list[int]) -> int:
    value = 0
    for digit, radix in zip(digits, radices):
        value = value * radix + digit
    return value


class Pseudonyms:
    """Replacements of values; equal values (whatever their case and separators) get equal ones."""

    def __init__(self, key: bytes):
        self.permute = Permutation(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def replaced(self, text: str, counts: dict[str, int]) -> str:
        if not MAY_HOLD(text):
            return text

        out, done, at = [], 0, 0
        while match := SHAPES.search(text, at):
            start, at = match.start(), match.start() + 1
            for kind, value in _readings(text, match):
                if kind == "ip" and VERSION.search(text, max(0, start - 12), start):
                    continue
                new = self.pseudonym(kind, value)
                if new is not None:
                    counts[kind] += 1
                    out += [text[done:start], new]
                    done = at = start + len(value)
                    break
        return "".join(out) + text[done:] if out else text

    def pseudonym(self, kind: str, value: str) -> str | None:
        """The replacement, or None for a value that is not valid."""
        if len(value) > SHORT:
            return getattr(self, f"_{kind}")(value)
        found = self.known.get((kind, value), "")
        if found == "":
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[kind, value] = getattr(self, f"_{kind}")(value)
        return found

    def _characters(self, text: str, tag: str) -> str:
        """Letters among letters and digits among digits (hexadecimal ones among themselves); case and the rest stay."""
        low = text.lower()
        hexadecimal = len(text) >= 8 and all(c in HEX for c in low) and any(c in DIGITS for c in low)
        sets = [HEX if hexadecimal else LETTERS if c in LETTERS else DIGITS if c in DIGITS else c for c in low]
        new, seen = [], hashlib.blake2b(digest_size=16)
        for at in range(0, len(low), BLOCK):
            part, part_sets = low[at:at + BLOCK], sets[at:at + BLOCK]
            radices = [len(s) for s in part_sets]
            start = _gathered([s.index(c) for s, c in zip(part_sets, part)], radices)
            # A later block depends on all before it, so equal blocks of different values do not show.
            chained = f"{tag} {seen.hexdigest()}" if at else tag
            new += [s[d] for s, d in zip(part_sets, _spread(self.permute(start, _size(radices), chained), radices))]
            seen.update(part.encode())
        if hexadecimal:
            return "".join(new).upper() if text.isupper() else "".join(new)
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, text))

    def _digits(self, digits: str, tag: str, wanted: Callable[[str], bool]) -> str:
        n = len(digits)
        new = self.permute(int(digits), 10 ** n, f"{tag}{n}", lambda v: wanted(str(v).zfill(n)))
        return str(new).zfill(n)

    def _email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        return f"{self._characters(local, 'email ' + domain.lower())}@{domain}"

    def _iban(self, value: str) -> str | None:
        bare = value.replace(" ", "")
        if not 15 <= len(bare) <= 34 or _mod97(bare[4:] + bare[:4]) != 1:
            return None
        sets = [DIGITS if c in DIGITS else LETTERS.upper() for c in bare[4:]]
        radices = [len(s) for s in sets]
        start = _gathered([s.index(c) for s, c in zip(sets, bare[4:])], radices)
        rest = "".join(s[d] for s, d in zip(sets, _spread(self.permute(start, _size(radices), "iban " + bare[:2]), radices)))
        return _refill(value, bare[:2] + f"{98 - _mod97(rest + bare[:2] + '00'):02d}" + rest)

    def _card(self, value: str) -> str | None:
        bare = re.sub("[^0-9]", "", value)
        if _luhn(bare):
            return None
        new = bare[0] + self._digits(bare[1:-1], "card" + bare[0], lambda _: True)
        return _refill(value, new + str(-_luhn(new + "0") % 10))

    def _ssn(self, value: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        bare = value.replace("-", "")
        return _refill(value, self._digits(bare, "ssn", valid)) if valid(bare) else None

    def _ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        low = [(0, 10, 100)[len(p) - 1] for p in parts]
        radices = [(10, 90, 156)[len(p) - 1] for p in parts]
        start = _gathered([int(p) - a for p, a in zip(parts, low)], radices)
        new = _spread(self.permute(start, _size(radices), f"ip {radices}"), radices)
        return ".".join(str(a + d) for a, d in zip(low, new))

    def _date(self, value: str) -> str | None:
        parsed = _parsed_date(value)
        if parsed is None:
            return None
        day, write = parsed
        new = self.permute((day - FIRST_DAY).days, DAYS, "date", lambda n: len(write(FIRST_DAY + dt.timedelta(n))) == len(value)
                           and (_parsed_date(write(FIRST_DAY + dt.timedelta(n))) or (None,))[0] == FIRST_DAY + dt.timedelta(n))
        return write(FIRST_DAY + dt.timedelta(new))

    def _phone(self, value: str) -> str | None:
        code = CODES.match(value)
        start = code.end() if code else 0
        bare = re.sub("[^0-9]", "", value[start:])
        if not start and value[0] not in "(0" and not NATIONAL.fullmatch(value):
            return None
        if not 7 <= len(bare) + (start and start - 1) <= 15 or len(bare) < 6:
            return None
        tag = "phone" + value[:start]
        zero = bare[0] == "0"
        north = value[:start] in ("", "+1") and len(bare) == 10 and bare[0] not in "01" and bare[3] not in "01"
        new = self._digits(bare, tag + "n" * north, lambda d: d[0] not in "01" and d[3] not in "01" if north else (d[0] == "0") == zero)
        return value[:start] + _refill(value[start:], new)

    def _secret(self, value: str) -> str | None:
        named = re.match(r"(?i:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-)|.*?[:=][ ]?[\"']?", value)
        fixed = named.end()
        # Behind a telling word a plain short word is no secret ("password: required").
        if named.group()[-1] in " :=\"'" and fixed + 20 > len(value) and not any(c.isdigit() for c in value[fixed:]):
            return None
        return value[:fixed] + self._characters(value[fixed:], "secret")


def _readings(text: str, match: re.Match) -> Iterator[tuple[str, str]]:
    """What may stand at the place of a match: its kind, with ends at earlier separators, then the later kinds."""
    first = "date" if match.lastgroup == "sep" else match.lastgroup
    later = False
    for kind, shape in KIND_SHAPES:
        later = later or kind == first
        found = match if kind == first else shape.match(text, match.start()) if later else None
        if found:
            value = found.group()
            yield kind, value
            if kind in ("iban", "card"):
                ends = [m.start() for m in re.finditer("[ -]", value)][::-1]
                for end in ends:
                    n = sum(c.isalnum() for c in value[:end])
                    if n == IBAN_LENGTHS.get(value[:2], n) and n >= 15 if kind == "iban" else n >= 13:
                        yield kind, value[:end]


def _size(radices: list[int]) -> int:
    n = 1
    for radix in radices:
        n *= radix
    return n


def _refill(shape: str, characters: str) -> str:
    """The characters in place of the letters and digits of ``shape``."""
    new = iter(characters)
    return "".join(next(new) if c.isalnum() else c for c in shape)


def _luhn(digits: str) -> int:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _parsed_date(value: str) -> tuple[dt.date, Callable[[dt.date], str]] | None:
    """The day and how to write another one alike; day first, or month first where only that is a date."""
    parts = re.split(r"[./-]", value)
    if "-" in value:
        orders = [(0, 1, 2)]
    else:
        orders = [(2, 1, 0)] if "." in value else [(2, 1, 0), (2, 0, 1)]
    sep = re.search(r"[./-]", value).group()
    for year, month, day in orders:
        try:
            found = dt.date(int(parts[year]), int(parts[month]), int(parts[day]))
        except ValueError:
            continue
        if not 0 <= (found - FIRST_DAY).days < DAYS:
            return None
        widths = [len(p) for p in parts]

        def write(d: dt.date, at=(year, month, day)) -> str:
            numbers = dict(zip(at, (d.year, d.month, d.day)))
            return sep.join(str(numbers[i]).zfill(widths[i]) for i in range(3))
        return found, write
    return None


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", counts_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; with ``counts_col``, also an array of counts by ``KINDS``.

    Mail addresses (the part before @), IBANs, payment cards, social security numbers, IPv4 addresses, dates, phone
    numbers and secrets after a telling word or prefix.  Numbers and dates must be valid (check digits, ranges,
    calendar) and stay so; every replacement has the length and shape of what it replaces.  The same value gets the
    same replacement in every document under one ``key``, without any table of values, and different values of one
    format get different ones.  Null texts stay null, empty ones empty; a text is handled whole, and a value of more than
    ``BLOCK`` characters block by block, each depending on those before it, so time grows with its length.  Numbers behind a
    word for versions are no addresses, short plain words behind a telling word no secrets.  Repeated rows repeat; other
    columns, whatever their names, stay as they are (``counts_col`` must not be one of them).  An empty table stays empty.
    """
    at = docs.columns.index(text_col)
    names = [*docs.columns, *([counts_col] if counts_col else [])]

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_ = Pseudonyms(key)
        for batch in batches:
            texts, totals = [], []
            for text in batch.column(at).to_pylist():
                counts = dict.fromkeys(KINDS, 0)
                texts.append(None if text is None else names_.replaced(text, counts))
                totals.append(list(counts.values()))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if counts_col:
                columns.append(pa.array(totals, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = docs.schema if not counts_col else docs.select("*", F.array().cast("array<bigint>").alias(counts_col)).schema
    return docs.mapInArrow(mask, schema)
