"""Fixed values of plate reading, and tables derived from them by rule."""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------------------

#: Characters that readers confuse, most likely first.
SIMILAR = {
    "0": ["O", "D", "Q", "C"],
    "O": ["0", "Q", "D", "C"],
    "1": ["I", "L", "7", "J", "3"],
    "I": ["1", "L", "7", "J"],
    "L": ["1", "I"],
    "2": ["Z"],
    "Z": ["2"],
    "4": ["A"],
    "A": ["4"],
    "5": ["S"],
    "S": ["5"],
    "8": ["B", "3"],
    "B": ["8", "3"],
    "6": ["G"],
    "G": ["6", "C"],
    "9": ["P"],
    "P": ["9", "F"],
    "Q": ["O", "0"],
    "D": ["O", "0"],
    "3": ["B", "8", "J", "1"],
    "7": ["1", "I", "T"],
    "T": ["7"],
    "C": ["G", "0", "O"],
    "E": ["F"],
    "F": ["E", "P"],
    "R": ["K"],
    "K": ["R", "X"],
    "M": ["N", "W"],
    "N": ["M", "H"],
    "H": ["N"],
    "V": ["U", "Y"],
    "U": ["V"],
    "J": ["1", "I", "3"],
    "W": ["M"],
    "Y": ["V"],
    "X": ["K"],
}

#: How likely a pair is confused, either way; other pairs have the default.
CONFUSION = {
    ("0", "O"): 0.95,
    ("0", "D"): 0.70,
    ("1", "I"): 0.90,
    ("1", "L"): 0.75,
    ("8", "B"): 0.90,
    ("5", "S"): 0.85,
    ("2", "Z"): 0.80,
    ("6", "G"): 0.75,
    ("7", "T"): 0.70,
    ("7", "1"): 0.60,
    ("0", "Q"): 0.55,
    ("0", "C"): 0.30,
    ("Q", "O"): 0.50,
    ("3", "B"): 0.50,
    ("3", "8"): 0.45,
    ("4", "A"): 0.55,
    ("9", "P"): 0.50,
    ("1", "J"): 0.40,
    ("3", "J"): 0.45,
    ("1", "3"): 0.30,
    ("C", "G"): 0.35,
    ("E", "F"): 0.30,
    ("P", "F"): 0.25,
    ("R", "K"): 0.20,
    ("K", "X"): 0.20,
    ("M", "N"): 0.35,
    ("M", "W"): 0.25,
    ("N", "H"): 0.30,
    ("V", "U"): 0.35,
    ("V", "Y"): 0.20,
    ("I", "L"): 0.50,
    ("I", "J"): 0.35,
    ("D", "O"): 0.60,
}
CONFUSION_DEFAULT = 0.10

#: Prefix ranges by state, as the validator has them.
VALIDATOR_RANGES = {
    "AC": [("QTA", "QTZ"), ("NAA", "NBZ")],
    "AL": [("QRA", "QSZ")],
    "AP": [("QOA", "QPZ")],
    "AM": [("QLA", "QNZ")],
    "BA": [("JAA", "JZZ"), ("NUA", "NZZ"), ("OAA", "OAZ"), ("QCA", "QDZ")],
    "CE": [("HTA", "HZZ"), ("QFA", "QHZ")],
    "DF": [("JKA", "JZZ"), ("OLA", "OMZ"), ("QGA", "QGZ")],
    "ES": [("MTA", "MZZ"), ("PPA", "PPZ"), ("QBA", "QBZ")],
    "GO": [("OAA", "OZZ"), ("QEA", "QEZ")],
    "MA": [("HSA", "HSZ"), ("QIA", "QIZ")],
    "MT": [("NGA", "NTZ"), ("QJA", "QKZ")],
    "MS": [("HRA", "HRZ"), ("NCA", "NFZ"), ("QQA", "QQZ")],
    "MG": [("GKJ", "HOK"), ("HAA", "HQZ"), ("OUA", "OZZ"), ("QVA", "QZZ")],
    "PA": [("QOA", "QPZ"), ("NNA", "NNZ")],
    "PB": [("QOA", "QOZ")],
    "PR": [("AAA", "BEZ"), ("AXA", "BFZ"), ("QMA", "QMZ")],
    "PE": [("QPA", "QPZ")],
    "PI": [("QNA", "QNZ")],
    "RJ": [("KMF", "LVE"), ("LAA", "LZZ"), ("QQA", "QSZ")],
    "RN": [("QOA", "QOZ")],
    "RS": [("IAA", "JZZ"), ("ICA", "IJZ"), ("QUA", "QUZ")],
    "RO": [("NBA", "NBZ"), ("QTA", "QTZ")],
    "RR": [("QOA", "QOZ")],
    "SC": [("MAA", "MSZ"), ("QJA", "QJZ")],
    "SP": [("BFA", "GKI"), ("CPA", "GKZ"), ("QWA", "QZZ")],
    "SE": [("QOA", "QOZ")],
    "TO": [("QOA", "QOZ")],
}

#: Prefix ranges by state, as the n-gram model has them; where states overlap the later one owns the prefix.
NGRAM_RANGES = {
    "AC": [("NAA", "NBZ"), ("QTA", "QTZ")],
    "AL": [("QRA", "QSZ")],
    "AP": [("OBA", "OBZ")],
    "AM": [("JWA", "JZZ"), ("NOA", "NQZ")],
    "BA": [("JAA", "JVZ"), ("NUA", "NZZ"), ("OAA", "OAZ"), ("QCA", "QDZ")],
    "CE": [("HTA", "HZZ"), ("NCA", "NFZ"), ("QFA", "QHZ")],
    "DF": [("JKA", "JMZ"), ("OLA", "OMZ"), ("QGA", "QGZ")],
    "ES": [("MTA", "MZZ"), ("PPA", "PPZ"), ("QBA", "QBZ")],
    "GO": [("NNA", "NTZ"), ("OCA", "OKZ"), ("QEA", "QEZ")],
    "MA": [("HSA", "HSZ"), ("NGA", "NMZ"), ("QIA", "QIZ")],
    "MT": [("JWA", "JZZ"), ("NGA", "NTZ"), ("QJA", "QKZ")],
    "MS": [("HRA", "HRZ"), ("NCA", "NFZ"), ("QQA", "QQZ")],
    "MG": [("GKJ", "HOK"), ("HAA", "HQZ"), ("OUA", "OZZ"), ("QVA", "QZZ")],
    "PA": [("NNA", "NNZ"), ("QOA", "QPZ")],
    "PB": [("OCA", "OKZ"), ("QOA", "QOZ")],
    "PR": [("AAA", "BEZ"), ("AXA", "BFZ"), ("QMA", "QMZ")],
    "PE": [("KMA", "LVE"), ("QPA", "QPZ")],
    "PI": [("OBA", "OBZ"), ("QNA", "QNZ")],
    "RJ": [("KMF", "LVE"), ("LAA", "LZZ"), ("QQA", "QSZ")],
    "RN": [("NNA", "NNZ"), ("QOA", "QOZ")],
    "RS": [("IAA", "JJZ"), ("ICA", "IJZ"), ("QUA", "QUZ")],
    "RO": [("NBA", "NBZ"), ("QTA", "QTZ")],
    "RR": [("NCA", "NCZ"), ("QOA", "QOZ")],
    "SC": [("MAA", "MSZ"), ("QJA", "QJZ")],
    "SP": [("BFA", "GKI"), ("CPA", "GKZ"), ("QWA", "QZZ")],
    "SE": [("JSA", "JTZ"), ("QOA", "QOZ")],
    "TO": [("NBA", "NBZ"), ("QOA", "QOZ")],
}

MERCOSUL_BIAS = 1.15
HINT_FACTOR = 1.5
KINDS = {"old": "LLLNNNN", "mercosul": "LLLNLNN"}
OLD = "^[A-Z]{3}[0-9]{4}$"
OLD_LOOSE = "^[A-Z]{3}[- ]?[0-9]{4}$"
MERCOSUL = "^[A-Z]{3}[0-9][A-Z][0-9]{2}$"
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".webm", ".dav")

# --- derived --------------------------------------------------------------------------------------

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
VOWELS = "AEIOU"


def weight(a: str, b: str) -> float:
    return CONFUSION.get((a, b), CONFUSION.get((b, a), CONFUSION_DEFAULT))


def replacements(allowed: str) -> dict[str, tuple[str, float]]:
    """What each character becomes where one of ``allowed`` is needed, and its weight; characters that have no way are left out."""
    found = {c: (c, 1.0) for c in allowed}
    for c, others in SIMILAR.items():
        fit = [o for o in others if o in allowed]
        if c not in found and fit:
            best = max(fit, key=lambda o: weight(c, o))
            found[c] = (best, weight(c, best))
    return found


NEED = {"L": replacements(LETTERS), "N": replacements(DIGITS), "C": replacements("".join(c for c in LETTERS if c not in VOWELS))}


def merged(ranges: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str]]:
    """The union of all ranges as few intervals, in order."""
    out: list[tuple[str, str]] = []
    for low, high in sorted(r for rs in ranges.values() for r in rs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def ordered(ranges: dict[str, list[tuple[str, str]]]) -> list[tuple[int, str, str, str]]:
    """(position in the table, state, low, high)."""
    return [(k, *r) for k, r in enumerate((s, a, b) for s, rs in ranges.items() for a, b in rs)]
