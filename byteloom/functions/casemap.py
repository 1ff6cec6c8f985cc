"""Simple one-for-one case mappings and white space, as of the Unicode version of JDK 17 (13.0). Written by a script from that JDK's character tables.

A row (first, count, step, shift) maps first, first + step, ... to itself plus shift."""

UPPER = (
    (0x61, 26, 1, -32), (0xB5, 1, 1, 743), (0xE0, 23, 1, -32), (0xF8, 7, 1, -32), (0xFF, 1, 1, 121), (0x101, 24, 2, -1), (0x131, 1, 1, -232),
    (0x133, 3, 2, -1), (0x13A, 8, 2, -1), (0x14B, 23, 2, -1), (0x17A, 3, 2, -1), (0x17F, 1, 1, -300), (0x180, 1, 1, 195), (0x183, 2, 2, -1),
    (0x188, 1, 1, -1), (0x18C, 1, 1, -1), (0x192, 1, 1, -1), (0x195, 1, 1, 97), (0x199, 1, 1, -1), (0x19A, 1, 1, 163), (0x19E, 1, 1, 130),
    (0x1A1, 3, 2, -1), (0x1A8, 1, 1, -1), (0x1AD, 1, 1, -1), (0x1B0, 1, 1, -1), (0x1B4, 2, 2, -1), (0x1B9, 1, 1, -1), (0x1BD, 1, 1, -1),
    (0x1BF, 1, 1, 56), (0x1C5, 1, 1, -1), (0x1C6, 1, 1, -2), (0x1C8, 1, 1, -1), (0x1C9, 1, 1, -2), (0x1CB, 1, 1, -1), (0x1CC, 1, 1, -2),
    (0x1CE, 8, 2, -1), (0x1DD, 1, 1, -79), (0x1DF, 9, 2, -1), (0x1F2, 1, 1, -1), (0x1F3, 1, 1, -2), (0x1F5, 1, 1, -1), (0x1F9, 20, 2, -1),
    (0x223, 9, 2, -1), (0x23C, 1, 1, -1), (0x23F, 2, 1, 10815), (0x242, 1, 1, -1), (0x247, 5, 2, -1), (0x250, 1, 1, 10783), (0x251, 1, 1, 10780),
    (0x252, 1, 1, 10782), (0x253, 1, 1, -210), (0x254, 1, 1, -206), (0x256, 2, 1, -205), (0x259, 1, 1, -202), (0x25B, 1, 1, -203),
    (0x25C, 1, 1, 42319), (0x260, 1, 1, -205), (0x261, 1, 1, 42315), (0x263, 1, 1, -207), (0x265, 1, 1, 42280), (0x266, 1, 1, 42308),
    (0x268, 1, 1, -209), (0x269, 1, 1, -211), (0x26A, 1, 1, 42308), (0x26B, 1, 1, 10743), (0x26C, 1, 1, 42305), (0x26F, 1, 1, -211),
    (0x271, 1, 1, 10749), (0x272, 1, 1, -213), (0x275, 1, 1, -214), (0x27D, 1, 1, 10727), (0x280, 1, 1, -218), (0x282, 1, 1, 42307),
    (0x283, 1, 1, -218), (0x287, 1, 1, 42282), (0x288, 1, 1, -218), (0x289, 1, 1, -69), (0x28A, 2, 1, -217), (0x28C, 1, 1, -71), (0x292, 1, 1, -219),
    (0x29D, 1, 1, 42261), (0x29E, 1, 1, 42258), (0x345, 1, 1, 84), (0x371, 2, 2, -1), (0x377, 1, 1, -1), (0x37B, 3, 1, 130), (0x3AC, 1, 1, -38),
    (0x3AD, 3, 1, -37), (0x3B1, 17, 1, -32), (0x3C2, 1, 1, -31), (0x3C3, 9, 1, -32), (0x3CC, 1, 1, -64), (0x3CD, 2, 1, -63), (0x3D0, 1, 1, -62),
    (0x3D1, 1, 1, -57), (0x3D5, 1, 1, -47), (0x3D6, 1, 1, -54), (0x3D7, 1, 1, -8), (0x3D9, 12, 2, -1), (0x3F0, 1, 1, -86), (0x3F1, 1, 1, -80),
    (0x3F2, 1, 1, 7), (0x3F3, 1, 1, -116), (0x3F5, 1, 1, -96), (0x3F8, 1, 1, -1), (0x3FB, 1, 1, -1), (0x430, 32, 1, -32), (0x450, 16, 1, -80),
    (0x461, 17, 2, -1), (0x48B, 27, 2, -1), (0x4C2, 7, 2, -1), (0x4CF, 1, 1, -15), (0x4D1, 48, 2, -1), (0x561, 38, 1, -48), (0x10D0, 43, 1, 3008),
    (0x10FD, 3, 1, 3008), (0x13F8, 6, 1, -8), (0x1C80, 1, 1, -6254), (0x1C81, 1, 1, -6253), (0x1C82, 1, 1, -6244), (0x1C83, 2, 1, -6242),
    (0x1C85, 1, 1, -6243), (0x1C86, 1, 1, -6236), (0x1C87, 1, 1, -6181), (0x1C88, 1, 1, 35266), (0x1D79, 1, 1, 35332), (0x1D7D, 1, 1, 3814),
    (0x1D8E, 1, 1, 35384), (0x1E01, 75, 2, -1), (0x1E9B, 1, 1, -59), (0x1EA1, 48, 2, -1), (0x1F00, 8, 1, 8), (0x1F10, 6, 1, 8), (0x1F20, 8, 1, 8),
    (0x1F30, 8, 1, 8), (0x1F40, 6, 1, 8), (0x1F51, 4, 2, 8), (0x1F60, 8, 1, 8), (0x1F70, 2, 1, 74), (0x1F72, 4, 1, 86), (0x1F76, 2, 1, 100),
    (0x1F78, 2, 1, 128), (0x1F7A, 2, 1, 112), (0x1F7C, 2, 1, 126), (0x1F80, 8, 1, 8), (0x1F90, 8, 1, 8), (0x1FA0, 8, 1, 8), (0x1FB0, 2, 1, 8),
    (0x1FB3, 1, 1, 9), (0x1FBE, 1, 1, -7205), (0x1FC3, 1, 1, 9), (0x1FD0, 2, 1, 8), (0x1FE0, 2, 1, 8), (0x1FE5, 1, 1, 7), (0x1FF3, 1, 1, 9),
    (0x214E, 1, 1, -28), (0x2170, 16, 1, -16), (0x2184, 1, 1, -1), (0x24D0, 26, 1, -26), (0x2C30, 47, 1, -48), (0x2C61, 1, 1, -1),
    (0x2C65, 1, 1, -10795), (0x2C66, 1, 1, -10792), (0x2C68, 3, 2, -1), (0x2C73, 1, 1, -1), (0x2C76, 1, 1, -1), (0x2C81, 50, 2, -1),
    (0x2CEC, 2, 2, -1), (0x2CF3, 1, 1, -1), (0x2D00, 38, 1, -7264), (0x2D27, 1, 1, -7264), (0x2D2D, 1, 1, -7264), (0xA641, 23, 2, -1),
    (0xA681, 14, 2, -1), (0xA723, 7, 2, -1), (0xA733, 31, 2, -1), (0xA77A, 2, 2, -1), (0xA77F, 5, 2, -1), (0xA78C, 1, 1, -1), (0xA791, 2, 2, -1),
    (0xA794, 1, 1, 48), (0xA797, 10, 2, -1), (0xA7B5, 6, 2, -1), (0xA7C3, 1, 1, -1), (0xA7C8, 2, 2, -1), (0xA7F6, 1, 1, -1), (0xAB53, 1, 1, -928),
    (0xAB70, 80, 1, -38864), (0xFF41, 26, 1, -32), (0x10428, 40, 1, -40), (0x104D8, 36, 1, -40), (0x10CC0, 51, 1, -64), (0x118C0, 32, 1, -32),
    (0x16E60, 32, 1, -32), (0x1E922, 34, 1, -34),
)
LOWER = (
    (0x41, 26, 1, 32), (0xC0, 23, 1, 32), (0xD8, 7, 1, 32), (0x100, 24, 2, 1), (0x130, 1, 1, -199), (0x132, 3, 2, 1), (0x139, 8, 2, 1),
    (0x14A, 23, 2, 1), (0x178, 1, 1, -121), (0x179, 3, 2, 1), (0x181, 1, 1, 210), (0x182, 2, 2, 1), (0x186, 1, 1, 206), (0x187, 1, 1, 1),
    (0x189, 2, 1, 205), (0x18B, 1, 1, 1), (0x18E, 1, 1, 79), (0x18F, 1, 1, 202), (0x190, 1, 1, 203), (0x191, 1, 1, 1), (0x193, 1, 1, 205),
    (0x194, 1, 1, 207), (0x196, 1, 1, 211), (0x197, 1, 1, 209), (0x198, 1, 1, 1), (0x19C, 1, 1, 211), (0x19D, 1, 1, 213), (0x19F, 1, 1, 214),
    (0x1A0, 3, 2, 1), (0x1A6, 1, 1, 218), (0x1A7, 1, 1, 1), (0x1A9, 1, 1, 218), (0x1AC, 1, 1, 1), (0x1AE, 1, 1, 218), (0x1AF, 1, 1, 1),
    (0x1B1, 2, 1, 217), (0x1B3, 2, 2, 1), (0x1B7, 1, 1, 219), (0x1B8, 1, 1, 1), (0x1BC, 1, 1, 1), (0x1C4, 1, 1, 2), (0x1C5, 1, 1, 1),
    (0x1C7, 1, 1, 2), (0x1C8, 1, 1, 1), (0x1CA, 1, 1, 2), (0x1CB, 9, 2, 1), (0x1DE, 9, 2, 1), (0x1F1, 1, 1, 2), (0x1F2, 2, 2, 1), (0x1F6, 1, 1, -97),
    (0x1F7, 1, 1, -56), (0x1F8, 20, 2, 1), (0x220, 1, 1, -130), (0x222, 9, 2, 1), (0x23A, 1, 1, 10795), (0x23B, 1, 1, 1), (0x23D, 1, 1, -163),
    (0x23E, 1, 1, 10792), (0x241, 1, 1, 1), (0x243, 1, 1, -195), (0x244, 1, 1, 69), (0x245, 1, 1, 71), (0x246, 5, 2, 1), (0x370, 2, 2, 1),
    (0x376, 1, 1, 1), (0x37F, 1, 1, 116), (0x386, 1, 1, 38), (0x388, 3, 1, 37), (0x38C, 1, 1, 64), (0x38E, 2, 1, 63), (0x391, 17, 1, 32),
    (0x3A3, 9, 1, 32), (0x3CF, 1, 1, 8), (0x3D8, 12, 2, 1), (0x3F4, 1, 1, -60), (0x3F7, 1, 1, 1), (0x3F9, 1, 1, -7), (0x3FA, 1, 1, 1),
    (0x3FD, 3, 1, -130), (0x400, 16, 1, 80), (0x410, 32, 1, 32), (0x460, 17, 2, 1), (0x48A, 27, 2, 1), (0x4C0, 1, 1, 15), (0x4C1, 7, 2, 1),
    (0x4D0, 48, 2, 1), (0x531, 38, 1, 48), (0x10A0, 38, 1, 7264), (0x10C7, 1, 1, 7264), (0x10CD, 1, 1, 7264), (0x13A0, 80, 1, 38864),
    (0x13F0, 6, 1, 8), (0x1C90, 43, 1, -3008), (0x1CBD, 3, 1, -3008), (0x1E00, 75, 2, 1), (0x1E9E, 1, 1, -7615), (0x1EA0, 48, 2, 1),
    (0x1F08, 8, 1, -8), (0x1F18, 6, 1, -8), (0x1F28, 8, 1, -8), (0x1F38, 8, 1, -8), (0x1F48, 6, 1, -8), (0x1F59, 4, 2, -8), (0x1F68, 8, 1, -8),
    (0x1F88, 8, 1, -8), (0x1F98, 8, 1, -8), (0x1FA8, 8, 1, -8), (0x1FB8, 2, 1, -8), (0x1FBA, 2, 1, -74), (0x1FBC, 1, 1, -9), (0x1FC8, 4, 1, -86),
    (0x1FCC, 1, 1, -9), (0x1FD8, 2, 1, -8), (0x1FDA, 2, 1, -100), (0x1FE8, 2, 1, -8), (0x1FEA, 2, 1, -112), (0x1FEC, 1, 1, -7), (0x1FF8, 2, 1, -128),
    (0x1FFA, 2, 1, -126), (0x1FFC, 1, 1, -9), (0x2126, 1, 1, -7517), (0x212A, 1, 1, -8383), (0x212B, 1, 1, -8262), (0x2132, 1, 1, 28),
    (0x2160, 16, 1, 16), (0x2183, 1, 1, 1), (0x24B6, 26, 1, 26), (0x2C00, 47, 1, 48), (0x2C60, 1, 1, 1), (0x2C62, 1, 1, -10743),
    (0x2C63, 1, 1, -3814), (0x2C64, 1, 1, -10727), (0x2C67, 3, 2, 1), (0x2C6D, 1, 1, -10780), (0x2C6E, 1, 1, -10749), (0x2C6F, 1, 1, -10783),
    (0x2C70, 1, 1, -10782), (0x2C72, 1, 1, 1), (0x2C75, 1, 1, 1), (0x2C7E, 2, 1, -10815), (0x2C80, 50, 2, 1), (0x2CEB, 2, 2, 1), (0x2CF2, 1, 1, 1),
    (0xA640, 23, 2, 1), (0xA680, 14, 2, 1), (0xA722, 7, 2, 1), (0xA732, 31, 2, 1), (0xA779, 2, 2, 1), (0xA77D, 1, 1, -35332), (0xA77E, 5, 2, 1),
    (0xA78B, 1, 1, 1), (0xA78D, 1, 1, -42280), (0xA790, 2, 2, 1), (0xA796, 10, 2, 1), (0xA7AA, 1, 1, -42308), (0xA7AB, 1, 1, -42319),
    (0xA7AC, 1, 1, -42315), (0xA7AD, 1, 1, -42305), (0xA7AE, 1, 1, -42308), (0xA7B0, 1, 1, -42258), (0xA7B1, 1, 1, -42282), (0xA7B2, 1, 1, -42261),
    (0xA7B3, 1, 1, 928), (0xA7B4, 6, 2, 1), (0xA7C2, 1, 1, 1), (0xA7C4, 1, 1, -48), (0xA7C5, 1, 1, -42307), (0xA7C6, 1, 1, -35384), (0xA7C7, 2, 2, 1),
    (0xA7F5, 1, 1, 1), (0xFF21, 26, 1, 32), (0x10400, 40, 1, 40), (0x104B0, 36, 1, 40), (0x10C80, 51, 1, 64), (0x118A0, 32, 1, 32),
    (0x16E40, 32, 1, 32), (0x1E900, 34, 1, 34),
)


def _strings(rows) -> tuple[str, str]:
    own = [(a + k * step, shift) for a, n, step, shift in rows for k in range(n)]
    return "".join(chr(p) for p, _ in own), "".join(chr(p + shift) for p, shift in own)


UPPER_FROM, UPPER_TO = _strings(UPPER)
LOWER_FROM, LOWER_TO = _strings(LOWER)
WHITESPACE = "".join(map(chr, (0x9, 0xA, 0xB, 0xC, 0xD, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x205F, 0x3000)))
