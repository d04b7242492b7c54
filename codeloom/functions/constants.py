"""Fixed values of the code format: types, tables and patterns that any implementation must share."""

from __future__ import annotations

import random
from enum import IntEnum

from .aes import keystream


class Main(IntEnum):
    META = 0
    SEMANTIC = 1
    CONTENT = 2
    DATA = 3
    INSTANCE = 4
    ISCC = 5
    ID = 6
    FLAKE = 7


class Content(IntEnum):
    TEXT = 0
    IMAGE = 1
    AUDIO = 2
    VIDEO = 3
    MIXED = 4


class Composite(IntEnum):
    TEXT = 0
    IMAGE = 1
    AUDIO = 2
    VIDEO = 3
    MIXED = 4
    SUM = 5
    NONE = 6
    WIDE = 7


class Plain(IntEnum):
    NONE = 0


class Chain(IntEnum):
    PRIVATE = 0
    BITCOIN = 1
    ETHEREUM = 2
    POLYGON = 3


class Realm(IntEnum):
    REALM_0 = 0
    REALM_1 = 1


#: Names of subtypes by main type and version.
SUBTYPES = {
    (Main.META, 0): Plain,
    (Main.SEMANTIC, 0): Content,
    (Main.CONTENT, 0): Content,
    (Main.DATA, 0): Plain,
    (Main.INSTANCE, 0): Plain,
    (Main.ISCC, 0): Composite,
    (Main.ID, 0): Chain,
    (Main.ID, 1): Realm,
    (Main.FLAKE, 0): Plain,
}

# Fixed values.
SCHEME = "ISCC:"
CANONICAL = r"^ISCC:[A-Z2-7]{10,68}$"
PREFIXES = ("AA", "CA", "CE", "CI", "CM", "CQ", "EA", "EE", "EI", "EM", "EQ", "GA", "IA", "KA", "KE", "KI", "KM", "KQ", "KU", "KY", "K4", "MA", "ME", "MI", "MM", "OA")
MULTICODEC = bytes([0xCC, 0x01])
MULTIBASE = {"f": "base16", "b": "base32", "v": "base32hex", "z": "base58btc", "u": "base64url"}
LENGTHS = (32, 64, 72, 80, 96, 128, 160, 192, 224, 256, 320)
#: Optional units of a composite; the place in this list is the composite's length field.
UNITS = ((), (Main.CONTENT,), (Main.SEMANTIC,), (Main.SEMANTIC, Main.CONTENT), (Main.META,), (Main.META, Main.CONTENT), (Main.META, Main.SEMANTIC), (Main.META, Main.SEMANTIC, Main.CONTENT))
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: LF VT FF CR NEL LS PS
NEWLINES = "\n\x0b\x0c\r\x85\u2028\u2029"
#: What counts as white space: TAB LF VT FF CR SP NBSP BOM, the space separators, LS PS.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CID_HEADER = bytes([0x01, 0x55, 0x12, 0x20])
CID_MOST_BYTES = 262_144
MULTIHASH_BLAKE3 = "1e20"

# Fixed values of MinHash: multipliers and summands of the 64 permutations, and the prime.
MINHASH_PRIME = (1 << 61) - 1
MINHASH_A = (
    853146490016488653, 1849332765672628665, 1131688930666554379, 1936485333668353377, 890837126813020267,
    1988249303247129861, 1408894512544874755, 2140251716176616185, 1755124413189049421, 1355916793659431597,
    546586563822844083, 497603761441203021, 2000709902557454173, 1057597903350092207, 1576204252850880253,
    2078784234495706739, 1022616668454863635, 2150082342606334489, 712341150087765807, 1511757510246096559,
    1525853819909660573, 1263771796138990131, 1215963627200985263, 590069150281426443, 130824646248385081,
    962725325544728503, 1702561325943522847, 296074222435072629, 490211158716051523, 1255327197241792767,
    699458998727907367, 32930168991409845, 1985097843455124585, 362027841570125531, 1903252144040897835,
    900391845076405289, 547470123601853551, 1689373724032359119, 845594231933442371, 400331968021206285,
    174967108345233429, 876513700861085019, 505848386844809885, 1920468508342256199, 1292611725303815789,
    963317239501343903, 1730880032297268007, 284614929850059717, 1185026248283273081, 2167288823816985197,
    1214905315086686483, 1555253098157439857, 1048013650291539723, 1238618594841147605, 1213502582686547311,
    286300733803129311, 1250358511639043529, 407534797452854371, 960869149538623787, 1722699901467253087,
    1325704236119824319, 196979859428570839, 1669408735473259699, 781336617016068757,
)
MINHASH_B = (
    1089606993368836715, 726972438868274737, 66204585613901025, 1078410179646709132, 1343470117098523467,
    698653121981343911, 1248486536592473639, 1447963007834012793, 1034598851883537815, 1474008409379745934,
    793773480906057541, 980501101461882479, 963941556313537655, 233651787311327325, 243905121737149907,
    570269452476776142, 297633284648631084, 1516796967247398557, 1494795672066692649, 1728741177365151059,
    1029197538967983408, 1660732464170610344, 1399769594446678069, 506465470557005705, 1279720146829545181,
    860096419955634036, 411519685280832908, 69539191273403207, 1960489729088056217, 605092075716397684,
    1017496016211653149, 1304834535101321372, 949013511180032347, 1142776242221098779, 576980004709031232,
    1071272177143100544, 1494527341093835499, 1073290814142727850, 1285904200674942617, 1277176606329477335,
    343788427301735585, 2100915269685487331, 1227711252031557450, 18593166391963377, 2101884148332688233,
    191808277534686888, 2170124912729392024, 918430470748151293, 1831024560113812361, 1951365515851067694,
    744352348473654499, 1921518311887826722, 2020165648600700886, 1764930142256726985, 1903893374912839788,
    1449378957774802122, 1435825328374066345, 833197549717762813, 2238991044337210799, 748955638857938366,
    1834583747494146901, 222012292803592982, 901238460725547841, 1501611130776083278,
)


def _gear() -> tuple[int, ...]:
    """256 values of 31 bits: the key stream of AES-256 in counter mode with a key and counter of zeros."""
    data = keystream(bytes(32), 1024)
    return tuple(int.from_bytes(data[i : i + 4], "big") & 0x7FFFFFFF for i in range(0, 1024, 4))


GEAR = _gear()
FRAME_VALUES = 380


def _frame_pairs(seed: int = 10, n: int = 256) -> tuple[tuple[int, int], ...]:
    """256 pairs of different places in a frame signature, drawn by the Mersenne Twister."""
    draw, pairs = random.Random(seed), []
    while len(pairs) < n:
        a, b = draw.randint(0, FRAME_VALUES - 1), draw.randint(0, FRAME_VALUES - 1)
        if a != b:
            pairs.append((a, b))
    return tuple(pairs)


FRAME_PAIRS = _frame_pairs()
