"""Personal data replaced by format-preserving pseudonyms.

Numbers that validate as what they look like (payment cards by Luhn, IBANs by mod 97, social
security numbers by their ranges, phone numbers and IPv4 addresses by their form), real calendar
dates, e-mail names and quoted secrets are permuted by a keyed Feistel network over exactly the
values of their format. The permutation is the same in every task, so equal values stay linked
across documents and different values stay apart; a card is still a valid card, a date a date.

Found are: cards of 13 to 19 digits (plain, or grouped 4-4-4-4 or 4-6-5), phone numbers as
+country and groups of digits (7 to 15 in all), (212) 555-0199, 212-555-0199 and 1-800-555-0199,
social security numbers, IPv4 addresses, IBANs, dates as 2024-02-29 or 29.02.2024 with one of - / .,
mail names before an address, and values of 16 characters or more after token, secret, password or
key. Values of any length are permuted whole, long ones block by block, each block's permutation
depending on the blocks before it.

Narrow work on rows: no shuffle, nothing gathered. Definitions: a null text stays null with no
items; an empty or very long text is handled like any other (patterns have no nested repeats);
where finds overlap the first kind counts, in the order mail, secret, IBAN, card, social security,
phone, address, date; repeated rows are treated alike; columns pass through if named in ``keep``
whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_CARD = re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)")
_PHONE = re.compile(r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,14}(?!\d)){1,6}|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])(?:1-)?\d{3}([-.])\d{3}\1\d{4}(?![\d-])")
_SSN = re.compile(r"(?<![\d-])(\d{3})-(\d{2})-(\d{4})(?![\d-])")
_IP = re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DATE = re.compile(r"(?<![\d./-])(?:(\d{4})([-/.])(\d{2})\2(\d{2})|(\d{2})([-/.])(\d{2})\6(\d{4}))(?![\d/-]|\.\d)")
_MAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ ]?[:=][ ]?[\"']?([A-Za-z0-9_+/-]{16,})")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_BLOCK = 64  # characters of a long value that are permuted at once
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # to 2099-12-31


def _stretched(data: bytes, key: bytes, size: int) -> bytes:
    """``size`` keyed pseudo-random bytes."""
    if size <= 64:
        return hashlib.blake2b(data, key=key, digest_size=size).digest()
    return b"".join(hashlib.blake2b(data, key=key, salt=b"%d" % i).digest() for i in range((size + 63) // 64))


class Feistel:
    """A keyed permutation of 0 .. n - 1 for any n: a balanced network on enough bits, walked until inside.

    ``back`` gives its inverse.
    """

    def __init__(self, key: bytes, rounds: int = 8, back: bool = False):
        self.key, self.rounds, self.back = key, rounds, back

    def permute(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        name = tweak.encode()
        order = range(self.rounds)[::-1] if self.back else range(self.rounds)
        while True:
            left, right = x >> half, x & mask
            for i in order:
                seen, other = (left, right) if self.back else (right, left)
                f = int.from_bytes(_stretched(b"%d:%d:%d:" % (i, n, seen) + name, self.key, half // 8 + 8), "big")
                other ^= f & mask
                left, right = (other, seen) if self.back else (seen, other)
            x = left << half | right
            if x < n:
                return x


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total


def _refill(shape: str, chars: str) -> str:
    """``chars`` put where ``shape`` has digits."""
    it = iter(chars)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


class Pseudonyms:
    """Finds items in a text and permutes each within its format; ``back`` takes pseudonyms to what they stand for."""

    def __init__(self, key: bytes, back: bool = False):
        self.net = Feistel(key, back=back)
        self.finders: list[tuple[str, Callable]] = [("email", self._mails), ("secret", self._secrets), ("iban", self._ibans), ("card", self._cards), ("ssn", self._ssns), ("phone", self._phones), ("ip", self._ips), ("date", self._dates)]

    def _number(self, digits: str, tweak: str) -> str:
        return str(self.net.permute(int(digits), 10 ** len(digits), f"{tweak}{len(digits)}")).zfill(len(digits))

    def classes(self, s: str, tweak: str) -> str:
        """Digits stay digits, lower case stays lower case, upper case stays upper case.

        A value of up to two blocks is one permutation; in longer ones a block's depends on all before it.
        """
        if len(s) <= 2 * _BLOCK:
            return self._block(s, tweak)
        out, before = [], hashlib.blake2b(digest_size=16)
        for at in range(0, len(s), _BLOCK):
            part = s[at : at + _BLOCK]
            out.append(self._block(part, f"{tweak}{before.hexdigest()}"))
            before.update((out[-1] if self.net.back else part).encode())
        return "".join(out)

    def _block(self, s: str, tweak: str) -> str:
        hexed = "abcdef" if all(c in "0123456789abcdef" for c in s) else "ABCDEF" if all(c in "0123456789ABCDEF" for c in s) else ""
        if hexed and len(s) >= 16:
            alphabet = "0123456789" + hexed
            x = self.net.permute(int(s, 16), 16 ** len(s), f"{tweak}hex{len(s)}{hexed}")
            return "".join(alphabet[x >> 4 * i & 15] for i in reversed(range(len(s))))
        sets = ["0123456789" if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else c for c in s]
        x, n = 0, 1
        for c, have in zip(s, sets):
            x, n = x * len(have) + have.index(c), n * len(have)
        x = self.net.permute(x, n, f"{tweak}{''.join(h[0] for h in sets)}")
        out = []
        for have in reversed(sets):
            x, i = divmod(x, len(have))
            out.append(have[i])
        return "".join(reversed(out))

    def _mails(self, t: str):
        for m in _MAIL.finditer(t):
            start = m.start()
            while start and t[start - 1] in _LOCAL:
                start -= 1
            while start < m.start() and t[start] in ".-+%":
                start += 1
            if start < m.start():
                yield start, m.end(), self.classes(t[start : m.start()], "mail") + m.group()

    def _secrets(self, t: str):
        for m in _SECRET.finditer(t):
            yield m.start(1), m.end(1), self.classes(m.group(1), "secret")

    def _cards(self, t: str):
        for m in _CARD.finditer(t):
            d = _digits(m.group())
            if luhn(d) and len(set(d)) > 1:
                body = self._number(d[:-1], "card")
                yield m.start(), m.end(), _refill(m.group(), body + str(-_luhn_sum(body + "0") % 10))

    def _ssns(self, t: str):
        for m in _SSN.finditer(t):
            area, group, serial = map(int, m.groups())
            if area in (0, 666) or area >= 900 or not group or not serial:
                continue
            x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            x, s = divmod(self.net.permute(x, 898 * 99 * 9999, "ssn"), 9999)
            a, g = divmod(x, 99)
            yield m.start(), m.end(), f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"

    def _phones(self, t: str):
        for m in _PHONE.finditer(t):
            s = m.group()
            if s[0] == "+" and not 7 <= len(_digits(s)) <= 15:
                continue
            country = re.match(r"\+\d{1,3}(?=\D)|1-(?=\d{3}-)", s)
            head = country.group() if country else "+" if s[0] == "+" else ""
            rest = s[len(head) :]
            yield m.start(), m.end(), head + _refill(rest, self._number(_digits(rest), "phone"))

    def _ips(self, t: str):
        for m in _IP.finditer(t):
            parts = m.group().split(".")
            if any(int(p) > 255 or str(int(p)) != p for p in parts):
                continue
            low = [(0, 0, 10, 100)[len(p)] for p in parts]
            width = [(0, 10, 90, 156)[len(p)] for p in parts]
            x = 0
            for p, a, w in zip(parts, low, width):
                x = x * w + int(p) - a
            x, out = self.net.permute(x, math.prod(width), "ip" + "".join(str(len(p)) for p in parts)), []
            for a, w in zip(reversed(low), reversed(width)):
                x, i = divmod(x, w)
                out.append(str(i + a))
            yield m.start(), m.end(), ".".join(reversed(out))

    def _ibans(self, t: str):
        for m in _IBAN.finditer(t):
            s = m.group().replace(" ", "")
            if not 15 <= len(s) <= 34 or _mod97(s[4:] + s[:4]) != 1:
                continue
            body = self.classes(s[4:], "iban" + s[:2])
            new = s[:2] + f"{98 - _mod97(body + s[:2] + '00'):02d}" + body
            it = iter(new)
            yield m.start(), m.end(), "".join(" " if c == " " else next(it) for c in m.group())

    def _dates(self, t: str):
        for m in _DATE.finditer(t):
            year_first = m.group(1) is not None
            sep = m.group(2) if year_first else m.group(6)
            a, b = (m.group(3), m.group(4)) if year_first else (m.group(5), m.group(7))
            year = int(m.group(1) or m.group(8))
            # day first unless only month first can be a date
            orders = [(a, b)] if year_first else [(b, a), (a, b)]
            for k, (month, day) in enumerate(orders):
                try:
                    x = datetime.date(year, int(month), int(day)).toordinal() - _FIRST_DAY
                except ValueError:
                    continue
                if 0 <= x < _DAYS:
                    new = datetime.date.fromordinal(_FIRST_DAY + self._date(x, k if not year_first else 2))
                    yield m.start(), m.end(), sep.join([f"{new:%Y}", f"{new:%m}", f"{new:%d}"] if year_first else [f"{new:%d}", f"{new:%m}", f"{new:%Y}"] if k == 0 else [f"{new:%m}", f"{new:%d}", f"{new:%Y}"])
                break

    def _date(self, x: int, form: int) -> int:
        """Dates of one form are permuted among themselves: a month-first date must not read as day first."""
        while True:
            x = self.net.permute(x, _DAYS, "date")
            if form != 1 or datetime.date.fromordinal(_FIRST_DAY + x).day > 12:
                return x

    def apply(self, t: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and the items' kinds and places in the original."""
        found: list[tuple[int, int, str, str]] = []
        taken: set[int] = set()
        some = {k for k, there in (("email", "@" in t), ("secret", "=" in t or ":" in t)) if there}
        if _DIGIT.search(t):
            some |= {"iban", "card", "ssn", "phone", "ip", "date"}
        for kind, find in self.finders:
            if kind not in some:
                continue
            for start, end, new in find(t):
                if taken.isdisjoint(range(start, end)):
                    taken.update(range(start, end))
                    found.append((start, end, kind, new))
        if not found:
            return t, []
        found.sort()
        out, at = [], 0
        for start, end, _, new in found:
            out += [t[at:start], new]
            at = end
        return "".join(out) + t[at:], [(kind, s, e) for s, e, kind, _ in found]


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def pseudonymize(docs: DataFrame, key: str, keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """``keep`` columns with ``text`` replaced, and if asked n_items and items (kind, start, end)."""
    keep = keep or ["doc_id", "text"]
    if not key:
        raise ValueError("pseudonyms need a key")
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    extra = [T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(item))] if spans else []
    schema = T.StructType([docs.schema[c] for c in keep] + extra)
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def run(batches):
        import pyarrow as pa

        names = Pseudonyms(secret)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                done = [(None, []) if t is None else names.apply(t) for t in part.column("text").to_pylist()]
                arrays = [pa.array([d[0] for d in done], part.schema.field("text").type) if c == "text" else part.column(c) for c in keep]
                if spans:
                    arrays += [pa.array([len(d[1]) for d in done], pa.int64()), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in d[1]] for d in done], kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return docs.select(*keep).mapInArrow(run, schema)
