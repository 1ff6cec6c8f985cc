"""Functions over UTF-8 text with defined results on malformed bytes.

Those named ``*_bytes`` and those that take byte positions work on binary values, malformed or not; the others take strings, which are valid. Two ways of reading malformed
bytes are told apart: some functions trust what a lead byte announces, and some go by safe tokens, a lead byte with as many of the continuation bytes that it announces
(up to five) as follow it, any other byte alone; a token is valid if it encodes a code point in the shortest form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from byteloom.functions.binary import byte_at, chars, part, set_bytes, try_set_bytes, unchars
from byteloom.functions.casemap import LOWER_FROM, LOWER_TO, UPPER_FROM, UPPER_TO, WHITESPACE
from byteloom.functions.errors import OUT_OF_BOUNDS, ColumnOrName, both, col, num, strict, within

_C = "[\u0080-¿]"
TOKEN = rf"(?s)[À-ß]{_C}?|[à-ï]{_C}{{0,2}}|[ð-÷]{_C}{{0,3}}|[ø-û]{_C}{{0,4}}|[üý]{_C}{{0,5}}|."
#: Matches a token that is valid; tokens hold nothing but a lead byte and continuation bytes.
VALID = "(?s)^(?:[\0-\u007f]|[Â-ß].|à[ -¿].|[á-ìîï]..|í[\u0080-\u009f].|ð[\u0090-¿]..|[ñ-ó]...|ô[\u0080-\u008f]..)$"
_VALID_PART = "(?:[\0-\u007f]|[Â-ß]%s|à[ -¿]%s|[á-ìîï]%s{2}|í[\u0080-\u009f]%s|ð[\u0090-¿]%s{2}|[ñ-ó]%s{3}|ô[\u0080-\u008f]%s{2})" % ((_C,) * 7)
NOT_WELL_FORMED = "UTF-8 is not well formed"
TRUNCATED = "UTF-8 sequence truncated"


def _bind(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def tokens(b: ColumnOrName) -> Column:
    """The safe tokens, as strings of one character for each byte."""
    return F.regexp_extract_all(chars(b), F.lit(TOKEN), F.lit(0))


def is_valid(b: ColumnOrName) -> Column:
    return F.is_valid_utf8(col(b).cast("string"))


def is_ascii(b: ColumnOrName) -> Column:
    """Of a string or binary: no byte above 127."""
    b = col(b).cast("binary")
    return F.octet_length(chars(b)) == F.octet_length(b)


def count_code_points(s: ColumnOrName) -> Column:
    return F.char_length(col(s))


def count_code_points_bytes(b: ColumnOrName) -> Column:
    """Bytes that aren't continuation bytes."""
    return F.length(F.regexp_replace(chars(b), _C, ""))


def count_code_points_range(b: ColumnOrName, i: Column | int, n: Column | int) -> Column:
    b, i, n = col(b), num(i), num(n)
    return strict(within(i, n, F.octet_length(b)), count_code_points_bytes(part(b, i, n)), OUT_OF_BOUNDS)


def _substring(s: ColumnOrName, start: Column | int, n: Column | int):
    """``n`` code points from code point ``start`` (from 0) on. The start must be before the end, even for no code points, and all of them must be there."""
    s, start, n = col(s), num(start), num(n)
    count = F.char_length(s)
    missing = F.when(start >= count, start).otherwise(start + n)
    message = F.when(start < 0, "codePointStart is negative").when(n < 0, "codePointLength is negative").otherwise(F.concat(F.lit("UTF-8 does not contain "), missing.cast("string"), F.lit(" code points")))
    return (start >= 0) & (n >= 0) & (start < count) & (start.cast("bigint") + n <= count), F.substring(s, start + 1, n), message


substring, try_substring = both(_substring, "substring")


#: Stands for each byte that starts a token, to find the n-th.
_START = "\u0100"


def offset_of_code_point_bytes(b: ColumnOrName, n: Column | int, position: Column | int = 0) -> Column:
    """The byte place of the ``n``-th code point from byte ``position`` on, by counting bytes that aren't continuation bytes; for ``n`` = 0 the position itself. -1 if there is none."""
    b, n, position = col(b), num(n), num(position)
    tail = chars(part(b, position, F.octet_length(b) - position))
    size = F.char_length(tail)
    lead = F.char_length(F.call_function("substring_index", F.regexp_replace(tail, "[^\u0080-¿]", _START), F.lit(_START), n.cast("int") + 1))
    found = F.when(size <= n, -1).when(n == 0, position).when(lead >= size, -1).otherwise(position + lead)
    whole = F.when(n < F.char_length(b.cast("string")), F.octet_length(F.substring(b.cast("string"), F.lit(1), n.cast("int")))).otherwise(-1)
    inside = (position >= 0) & (position <= F.octet_length(b)) & (n >= 0)
    return strict(inside, F.when((position == 0) & is_valid(b), whole).otherwise(found), OUT_OF_BOUNDS)


def offset_of_code_point(s: ColumnOrName, n: Column | int) -> Column:
    """The byte place of the ``n``-th code point of valid text, or -1."""
    s, n = col(s), num(n)
    return F.when(s.isNotNull(), F.when((n >= 0) & (n < F.char_length(s)), F.octet_length(F.substring(s, F.lit(1), n))).otherwise(-1))


def _illegal(lead: Column) -> Column:
    return F.concat(F.lit("Illegal start 0x"), F.hex(lead.cast("bigint")), F.lit(" of code point"))


def length_of_start_byte(v: Column) -> Column:
    """Bytes that an unsigned lead byte announces; what can't lead is an error."""
    ok = ((v >= 0) & (v < 0x80)) | ((v >= 0xC0) & (v < 0xF8))
    return strict(ok, F.when(v < 0x80, 1).when(v < 0xE0, 2).when(v < 0xF0, 3).otherwise(4), _illegal(v))


def _substring_malformed(b: Column, start: Column, n: Column) -> Column:
    """(error, bytes) of the code points, trusting lead bytes."""
    missing = lambda k: F.concat(F.lit("UTF-8 does not contain "), k.cast("string"), F.lit(" code points"))
    out = lambda error, value: F.struct(error.cast("string").alias("error"), value.cast("binary").alias("bytes"))
    nothing = F.lit(None)

    def cut(first: Column, last: Column) -> Column:
        lead = byte_at(b, F.greatest(last, F.lit(0)))
        legal = (lead < 0x80) | ((lead >= 0xC0) & (lead < 0xF8))
        end = last + F.when(lead < 0x80, 1).when(lead < 0xE0, 2).when(lead < 0xF0, 3).otherwise(4)
        illegal = _illegal(lead)
        return F.when(last < 0, out(missing(start + n), nothing)).when(~legal, out(illegal, nothing)).when(end > F.octet_length(b), out(F.lit(NOT_WELL_FORMED), nothing)).otherwise(out(nothing, part(b, first, end - first)))

    def from_first(first: Column) -> Column:
        last = F.when(first >= 0, offset_of_code_point_bytes(b, F.greatest(n - 1, F.lit(0)), F.greatest(first, F.lit(0)))).otherwise(-1)
        return F.when(first < 0, out(missing(start), nothing)).when(n == 0, out(nothing, F.lit(b""))).otherwise(_bind(last, lambda x: cut(first, x)))

    return _bind(offset_of_code_point_bytes(b, F.greatest(start, F.lit(0))), from_first)


def _substring_bytes(b: ColumnOrName, start: Column | int, n: Column | int):
    """``substring`` of bytes, trusting lead bytes: the last code point takes what its lead byte announces, which must be there."""
    b, start, n = col(b), num(start), num(n)
    text = b.cast("string")
    _, value, message = _substring(text, start, n)
    count = F.char_length(text)
    fits = (start >= 0) & (n >= 0) & (start < count) & (start.cast("bigint") + n <= count)
    found = _substring_malformed(b, start, n)
    whole = is_valid(b)
    ok = F.when(b.isNull() | start.isNull() | n.isNull(), F.lit(None).cast("boolean")).when(whole | (start < 0) | (n < 0), fits).otherwise(found["error"].isNull())
    return ok, F.when(whole, value.cast("binary")).otherwise(found["bytes"]), F.when(whole | (start < 0) | (n < 0), message).otherwise(found["error"])


substring_bytes, try_substring_bytes = both(_substring_bytes, "substring_bytes")


def reverse(s: ColumnOrName) -> Column:
    return F.reverse(col(s).cast("string"))


def reverse_bytes(b: ColumnOrName) -> Column:
    """Tokens in reverse order, each as it is."""
    b = col(b)
    return F.when(is_ascii(b), unchars(F.reverse(chars(b)))).when(is_valid(b), F.reverse(b.cast("string")).cast("binary")).otherwise(unchars(F.array_join(F.reverse(tokens(b)), "")))


def utf16_key(s: ColumnOrName) -> Column:
    """A binary key that sorts text by UTF-16 units. Malformed text is an error."""
    s = col(s)
    return strict(F.is_valid_utf8(s.cast("string")), F.encode(s.cast("string"), "UTF-16BE"), NOT_WELL_FORMED)


def compare_utf16(a: ColumnOrName, b: ColumnOrName) -> Column:
    """-1, 0 or 1 by UTF-16 units. Unlike a comparison that stops at the first difference, this is an error if either text is malformed anywhere."""
    a, b = utf16_key(a), utf16_key(b)
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def _case(kind: str):
    native, source, target = (F.upper, UPPER_FROM, UPPER_TO) if kind == "upper" else (F.lower, LOWER_FROM, LOWER_TO)

    def text(s: ColumnOrName) -> Column:
        s = col(s)
        return F.when(is_ascii(s), native(s)).otherwise(F.translate(s, source, target))

    def raw(b: ColumnOrName) -> Column:
        b = col(b)
        mapped = F.transform(tokens(b), lambda t: F.when(t.rlike(VALID), chars(F.encode(F.translate(F.decode(unchars(t), "UTF-8"), source, target), "UTF-8"))).otherwise(t))
        return F.when(is_valid(b), text(b.cast("string")).cast("binary")).otherwise(unchars(F.array_join(mapped, "")))

    text.__name__, raw.__name__ = kind, kind + "_bytes"
    text.__doc__ = f"Each code point's simple {kind} case: one for one, without locale or context."
    raw.__doc__ = f"``{kind}`` of each valid token; malformed ones stay."
    return text, raw


upper, upper_bytes = _case("upper")
lower, lower_bytes = _case("lower")


def left_trim(s: ColumnOrName, what: str = WHITESPACE) -> Column:
    """Without leading code points of ``what``; by default white space, to which no-break spaces and U+0085 don't belong."""
    return F.ltrim(col(s), F.lit(what))


def right_trim(s: ColumnOrName, what: str = WHITESPACE) -> Column:
    return F.rtrim(col(s), F.lit(what))


def trim(s: ColumnOrName, what: str = WHITESPACE) -> Column:
    return F.btrim(col(s), F.lit(what))


def code_point_set(points: list[int]) -> str:
    """Code points to trim as a string; negative ones, surrogates and what is above U+10FFFF raise ValueError."""
    for p in points:
        if not 0 <= p <= 0x10FFFF or 0xD800 <= p <= 0xDFFF:
            raise ValueError(f"Invalid code point 0x{p & 0xFFFFFFFF:X}")
    return "".join(map(chr, points))


def _byte_class(what: str) -> str:
    """A pattern, over one character for each byte, of any of the code points."""
    own = ["".join(f"\\u{x:04x}" for x in c.encode()) for c in sorted(set(what))]
    return "(?:" + "|".join(own) + ")" if own else "(?!)"


def left_trim_bytes(b: ColumnOrName, what: str = WHITESPACE) -> Column:
    """Trimming stops at malformed bytes."""
    b = col(b)
    return F.when(is_valid(b), left_trim(b.cast("string"), what).cast("binary")).otherwise(_left_trim_malformed(b, what))


def _left_trim_malformed(b: Column, what: str) -> Column:
    return unchars(F.regexp_replace(chars(b), f"^{_byte_class(what)}+", ""))


def right_trim_bytes(b: ColumnOrName, what: str = WHITESPACE) -> Column:
    """Trimming from the end stops at a code point that isn't to go, or that isn't whole."""
    b = col(b)
    return F.when(is_valid(b), right_trim(b.cast("string"), what).cast("binary")).otherwise(_right_trim_malformed(b, what))


def _right_trim_malformed(b: Column, what: str) -> Column:
    return unchars(F.regexp_replace(chars(b), f"(?<!{_byte_class(what)}){_byte_class(what)}++\\z|^{_byte_class(what)}++\\z", ""))


def trim_bytes(b: ColumnOrName, what: str = WHITESPACE) -> Column:
    return right_trim_bytes(left_trim_bytes(b, what), what)


def fix_invalid(b: ColumnOrName, replacement: int | None = 0xFFFD) -> Column:
    """Malformed tokens replaced by a code point, one for each, or dropped for None."""
    mark = "" if replacement is None else code_point_set([replacement]).encode().decode("latin-1")
    b = col(b)
    fixed = F.transform(tokens(b), lambda t: F.when(t.rlike(VALID), t).otherwise(F.lit(mark)))
    return F.when(is_valid(b), b).otherwise(unchars(F.array_join(fixed, "")))


def _first_token(b: Column, i: Column) -> Column:
    return F.regexp_extract(chars(part(b, i, 6)), "^(?:" + TOKEN.replace("(?s)", "").removesuffix("|.") + "|(?s:.))", 0)


def _decode_token(t: Column) -> Column:
    """The code point of a token's bytes, by what its lead byte announces."""
    at = lambda k: F.ascii(F.substring(t, k + 1, 1)).bitwiseAND(F.lit(0x3F))
    lead = F.ascii(t)
    two = F.shiftleft(lead.bitwiseAND(F.lit(0x1F)), 6).bitwiseOR(at(1))
    three = F.shiftleft(lead.bitwiseAND(F.lit(0x0F)), 12).bitwiseOR(F.shiftleft(at(1), 6)).bitwiseOR(at(2))
    four = F.shiftleft(lead.bitwiseAND(F.lit(0x07)), 18).bitwiseOR(F.shiftleft(at(1), 12)).bitwiseOR(F.shiftleft(at(2), 6)).bitwiseOR(at(3))
    return F.when(lead < 0x80, lead).when(lead < 0xE0, two).when(lead < 0xF0, three).otherwise(four)


def _try_code_point(b: ColumnOrName, i: Column | int):
    """The code point at byte ``i``, or minus the number of bytes of the malformed token there."""
    b, i = col(b), num(i)
    value = _bind(_first_token(b, i), lambda t: F.when(t.rlike(VALID), _decode_token(t)).otherwise(-F.char_length(t)))
    return within(i, 1, F.octet_length(b)), value, OUT_OF_BOUNDS


code_point_or_length, try_code_point_or_length = both(_try_code_point, "code_point_or_length")


def _code_point_at(b: ColumnOrName, i: Column | int):
    """The code point at byte ``i``, as its lead byte announces; what follows isn't looked at."""
    b, i = col(b), num(i)
    inside = within(i, 1, F.octet_length(b))

    def whole(lead: Column) -> Column:
        size = F.when(lead < 0x80, 1).when(lead < 0xE0, 2).when(lead < 0xF0, 3).otherwise(4)
        return ((lead < 0x80) | ((lead >= 0xC0) & (lead < 0xF8))) & (i + size <= F.octet_length(b))

    illegal = lambda lead: F.when((lead >= 0xC0) & (lead < 0xF8), TRUNCATED).otherwise(_illegal(lead))
    message = F.when(~inside, OUT_OF_BOUNDS).otherwise(_bind(byte_at(b, i), illegal))
    ok = F.when(inside.isNull(), F.lit(None).cast("boolean")).when(~inside, False).otherwise(_bind(byte_at(b, i), whole))
    return ok, _bind(chars(part(b, i, 4)), _decode_token), message


code_point_at, try_code_point_at = both(_code_point_at, "code_point_at")


def _safe_length(b: ColumnOrName, i: Column | int):
    """Bytes of the safe token at byte ``i``."""
    b, i = col(b), num(i)
    return within(i, 1, F.octet_length(b)), F.char_length(_first_token(b, i)), OUT_OF_BOUNDS


length_of_code_point_safe, try_length_of_code_point_safe = both(_safe_length, "length_of_code_point_safe")


def length_of_code_point_at(b: ColumnOrName, i: Column | int) -> Column:
    """Bytes that the lead byte at ``i`` announces."""
    b, i = col(b), num(i)
    return strict(within(i, 1, F.octet_length(b)), length_of_start_byte(byte_at(b, i)), OUT_OF_BOUNDS)


def _invalid(cp: Column) -> Column:
    return F.concat(F.lit("Invalid code point 0x"), F.when(cp < 0, F.right(F.hex(cp.cast("bigint")), F.lit(8))).otherwise(F.hex(cp.cast("bigint"))))


def _length_of(cp: ColumnOrName):
    """Bytes of a code point's UTF-8; surrogates take 3."""
    cp = col(cp)
    return (cp >= 0) & (cp <= 0x10FFFF), F.when(cp < 0x80, 1).when(cp < 0x800, 2).when(cp < 0x10000, 3).otherwise(4), _invalid(cp)


length_of_code_point, try_length_of_code_point = both(_length_of, "length_of_code_point")


def _code_point_before(b: ColumnOrName, i: Column | int):
    """The code point that ends at byte ``i``; a byte there that doesn't continue one is given as it is."""
    b, i = col(b), num(i)
    inside = (i >= 1) & (i <= F.octet_length(b))
    tail = chars(part(b, F.greatest(i - 4, F.lit(0)), F.least(i, F.lit(4))))
    back = F.regexp_extract(tail, f"(?s)[^\u0080-¿]{_C}*\\z", 0)

    def whole(x: Column) -> Column:
        """The lead byte may announce more than lies before i, and reads on beyond it."""
        lead = F.ascii(x)
        need = F.when(lead < 0x80, 1).when(lead < 0xE0, 2).when(lead < 0xF0, 3).otherwise(4)
        return F.when(F.char_length(x) == 1, True).when(F.char_length(x) == 0, False).otherwise((lead < 0xF8) & (i - F.char_length(x) + need <= F.octet_length(b)))

    why = lambda x: F.when(F.char_length(x) == 0, NOT_WELL_FORMED).when(F.ascii(x) >= 0xF8, _illegal(F.ascii(x))).otherwise(TRUNCATED)
    value = lambda x: F.when(F.char_length(x) == 1, F.ascii(x)).otherwise(_bind(chars(part(b, i - F.char_length(x), 4)), _decode_token))
    ok = F.when(inside.isNull(), F.lit(None).cast("boolean")).when(~inside, False).otherwise(_bind(back, whole))
    return ok, _bind(back, value), F.when(~inside, OUT_OF_BOUNDS).otherwise(_bind(back, why))


code_point_before, try_code_point_before = both(_code_point_before, "code_point_before")


def _to_code_points(b: ColumnOrName):
    """The code points of text, a string or binary; malformed bytes are an error that tells where."""
    b = col(b).cast("binary")
    wide = F.encode(b.cast("string"), "UTF-32")
    points = F.when(F.octet_length(b) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest((F.octet_length(wide) / 4).cast("int") - 1, F.lit(0))), lambda i: F.conv(F.hex(F.substring(wide, i * 4 + 1, F.lit(4))), 16, 10).cast("int"))
    )
    place = F.char_length(F.regexp_extract(chars(b), f"(?s)^{_VALID_PART}*+", 0))
    return is_valid(b), points, F.concat(F.lit("Invalid UTF-8 sequence at position "), place.cast("string"))


to_code_points, try_to_code_points = both(_to_code_points, "to_code_points")


def _byte_lengths(b: ColumnOrName):
    """What the lead bytes announce, one after the other, up to 6; a byte that can't lead, and a code point that runs beyond the end, are errors."""
    b = col(b).cast("binary")
    lead = "(?:[\0-\u007f]|[À-ß].|[à-ï]..|[ð-÷].{3}|[ø-û].{4}|[üý].{5})"
    legal = F.char_length(F.regexp_extract(chars(b), f"(?s)^{lead}*+", 0))
    sizes = F.transform(F.regexp_extract_all(chars(b), F.lit("(?s)" + lead), F.lit(0)), lambda t: F.char_length(t).cast("tinyint"))
    return legal == F.octet_length(b), sizes, F.concat(F.lit("Invalid UTF-8 sequence at position "), legal.cast("string"))


code_point_byte_lengths, try_code_point_byte_lengths = both(_byte_lengths, "code_point_byte_lengths")


def _encodable(cp: Column) -> Column:
    return (cp >= 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)


def _utf32(a: Column) -> Column:
    # the decoder takes a first U+FEFF for a byte order mark, so one goes first
    units = F.array_join(F.transform(a, lambda c: F.lpad(F.hex(c.cast("bigint")), 8, "0")), "")
    return F.encode(F.decode(F.unhex(F.concat(F.lit("0000FEFF"), units)), "UTF-32"), "UTF-8")


def _from_code_points(a: ColumnOrName):
    """UTF-8 of an array of code points; what is negative, a surrogate or above U+10FFFF is an error. A NULL element makes NULL."""
    a = col(a)
    bad = F.get(F.filter(a, lambda c: ~_encodable(c)), F.lit(0))
    ok = F.when(F.exists(a, lambda c: c.isNull()), F.lit(None).cast("boolean")).otherwise(F.forall(a, _encodable))
    return ok, F.when(F.size(a) == 0, F.lit(b"")).otherwise(_utf32(a)), _invalid(bad)


from_code_points, try_from_code_points = both(_from_code_points, "from_code_points")


def from_code_points_range(a: ColumnOrName, i: Column | int, n: Column | int) -> Column:
    a, i, n = col(a), num(i), num(n)
    return strict(within(i, n, F.size(a)), from_code_points(F.slice(a, i + 1, n)), OUT_OF_BOUNDS)


def code_point_to_utf8(cp: ColumnOrName) -> Column:
    cp = col(cp)
    return F.when(cp.isNotNull(), from_code_points(F.array(cp)))


def set_code_point_at(cp: ColumnOrName, b: ColumnOrName, i: Column | int) -> Column:
    """(buffer, length): ``b`` with the code point written at byte ``i``, where it must fit in, and its length."""
    own = code_point_to_utf8(cp)
    return F.struct(set_bytes(b, i, own).alias("buffer"), F.octet_length(own).alias("length"))


def try_set_code_point_at(cp: ColumnOrName, b: ColumnOrName, i: Column | int) -> Column:
    own = F.when(_encodable(col(cp)), _utf32(F.array(col(cp))))
    out = try_set_bytes(b, i, own)
    return F.when(out.isNotNull(), F.struct(out.alias("buffer"), F.octet_length(own).alias("length")))
