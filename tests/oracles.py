"""Plain Python versions of the functions, one value at a time."""

INVALID = [bytes.fromhex(x) for x in "BF DF EF EFBF F7 F7BF F7BFBF F7BFBFBF FB FBBF FBBFBF FBBFBFBF FBBFBFBFBF FD FDBF FDBFBF FDBFBFBF FDBFBFBFBF FDBFBFBFBFBF FF EDA080 EDBFBF C0AF C1BF E081BF E09080 E09FBF F08DA080 F08DBFBF F08FBFBF".split()]
TEXTS = ["", "hello", "Quadratically", "Österreich", "Duliö duliö", "信念,爱,希望", "naïve", "\U0001042dend", "ß ı İ ΑΣ ȺȾ ŉ", "  x  ", "".join(map(chr, range(128))), " \u0085x "]


def announced(lead):
    for limit, n in ((0x80, 1), (0xC0, 1), (0xE0, 2), (0xF0, 3), (0xF8, 4), (0xFC, 5), (0xFE, 6)):
        if lead < limit:
            return n
    return 1


def cont(x):
    return x & 0xC0 == 0x80


def token(b, i):
    n, j = announced(b[i]), i + 1
    while j < len(b) and j < i + n and cont(b[j]):
        j += 1
    return b[i:j]


def tokens(b):
    out, i = [], 0
    while i < len(b):
        out.append(token(b, i))
        i += len(out[-1])
    return out


def valid(t):
    try:
        return len(t.decode()) == 1
    except UnicodeDecodeError:
        return False


def is_valid(b):
    return all(map(valid, tokens(b)))


def try_code_point(b, i):
    t = token(b, i)
    return ord(t.decode()) if valid(t) else -len(t)


def raw_code_point(b, i):
    """None for an error."""
    x = b[i]
    if x < 0x80:
        return x
    n = announced(x)
    if x < 0xC0 or x >= 0xF8 or i + n > len(b):
        return None
    out = x & (0x3F >> (n - 1))
    for k in range(1, n):
        out = out << 6 | b[i + k] & 0x3F
    return out


def code_point_before(b, i):
    if not cont(b[i - 1]):
        return b[i - 1]
    for k in (2, 3, 4):
        if i < k:
            return None
        if not cont(b[i - k]):
            return raw_code_point(b, i - k)
    return None


def count(b):
    return sum(not cont(x) for x in b)


def offset_of(b, n, position=0):
    if len(b) - position <= n:
        return -1
    if n == 0:
        return position
    starts = [i for i in range(position, len(b)) if not cont(b[i])]
    return starts[n] if n < len(starts) else -1


def substring(b, start, n):
    """None for an error."""
    first = offset_of(b, start)
    if first < 0:
        return None
    if n == 0:
        return b""
    last = offset_of(b, n - 1, first)
    if last < 0 or 0x80 <= b[last] < 0xC0 or b[last] >= 0xF8:
        return None
    end = last + announced(b[last])
    return b[first:end] if end <= len(b) else None


def byte_lengths(b):
    out, i = [], 0
    while i < len(b):
        n = announced(b[i])
        if cont(b[i]) or b[i] >= 0xFE or i + n > len(b):
            return None
        out.append(n)
        i += n
    return out


def map_case(b, table):
    return b"".join(table.get(t.decode(), t.decode()).encode() if valid(t) else t for t in tokens(b))


def left_trim(b, what):
    own = tokens(b)
    while own and valid(own[0]) and own[0].decode() in what:
        own.pop(0)
    return b"".join(own)


def right_trim(b, what):
    """From the end: a code point counts if the bytes before the end are a valid one."""
    while b:
        k = 1
        while k <= min(4, len(b)) and not (valid(b[-k:])):
            k += 1
        if k > min(4, len(b)) or b[-k:].decode() not in what:
            break
        b = b[:-k]
    return b


def fix(b, mark):
    return b"".join(t if valid(t) else mark for t in tokens(b))


def index_of(b, p, o):
    return -1 if not b or o < 0 or o >= len(b) else (o if not p else b.find(p, o))


def last_index_of(b, p, o):
    if not b and not p:
        return 0
    if not b or o < 0:
        return -1
    if not p:
        return min(o, len(b))
    return max((i for i in range(0, min(o, len(b) - len(p)) + 1) if b[i : i + len(p)] == p), default=-1)


M64 = (1 << 64) - 1


def rot(x, r, bits=64):
    return (x << r | x >> (bits - r)) & ((1 << bits) - 1)


def word(b, i, n=8):
    return int.from_bytes(b[i : i + n], "little")


def murmur32(b, seed):
    m = (1 << 32) - 1
    h, n = seed & m, len(b)
    for i in range(0, n // 4 * 4, 4):
        h ^= rot(word(b, i, 4) * 0xCC9E2D51 & m, 15, 32) * 0x1B873593 & m
        h = (rot(h, 13, 32) * 5 + 0xE6546B64) & m
    if n % 4:
        h ^= rot(word(b, n // 4 * 4, 4) * 0xCC9E2D51 & m, 15, 32) * 0x1B873593 & m
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur128(b, seed):
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed & M64
    n = len(b)
    for i in range(0, n // 16 * 16, 16):
        h1 ^= rot(word(b, i) * c1 & M64, 31) * c2 & M64
        h1 = ((rot(h1, 27) + h2) * 5 + 0x52DCE729) & M64
        h2 ^= rot(word(b, i + 8) * c2 & M64, 33) * c1 & M64
        h2 = ((rot(h2, 31) + h1) * 5 + 0x38495AB5) & M64
    t = b[n // 16 * 16 :]
    h2 ^= rot(word(t, 8) * c2 & M64, 33) * c1 & M64
    h1 ^= rot(word(t, 0) * c1 & M64, 31) * c2 & M64
    h1, h2 = h1 ^ n, h2 ^ n
    h1 = h1 + h2 & M64
    h2 = h2 + h1 & M64

    def mix(k):
        k = (k ^ k >> 33) * 0xFF51AFD7ED558CCD & M64
        k = (k ^ k >> 33) * 0xC4CEB9FE1A85EC53 & M64
        return k ^ k >> 33

    h1, h2 = mix(h1), mix(h2)
    h1 = h1 + h2 & M64
    return h1.to_bytes(8, "little") + (h2 + h1 & M64).to_bytes(8, "little")


def fnv(b, bits):
    h, prime, m = (0x811C9DC5, 0x01000193, (1 << 32) - 1) if bits == 32 else (0xCBF29CE484222325, 0x100000001B3, M64)
    for x in b:
        h = (h ^ (x - 256 if x > 127 else x) & m) * prime & m
    return h
