"""Default term lists and settings of the cleaning job.

Every list is an argument of the job, so another catalogue only needs other files (``sources.scan_terms`` and
``sources.scan_units`` read them). Two lists have no default and are always inputs: the English word list and the
good tokens, both too long to state here.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# Units with their abbreviation, whether they are glued to the number behind them (prefix), and their
# forms, each with whether it only counts after a number.
UNITS = [
    {"abbrev": 'IN', "prefix": False, "forms": [('INCH', False), ('INCHES', False), ('ININ', True), ('"', True), ("''", True)]},
    {"abbrev": 'FT', "prefix": False, "forms": [('FEET', False), ('FOOT', True), ('FTFT', True), ("'", True)]},
    {"abbrev": 'YD', "prefix": False, "forms": [('YARDS', False), ('YARD', True), ('YDS', True)]},
    {"abbrev": 'MM', "prefix": False, "forms": [('MILLIMETER', False), ('MILLIMETERS', False), ('MILLIMETRE', False), ('MILLIMETRES', False), ('MILIMETER', False), ('MILIMETERS', False), ('MILIMETRE', False), ('MILIMETRES', False)]},
    {"abbrev": 'CM', "prefix": False, "forms": [('CENTIMETER', False), ('CENTIMETERS', False), ('CENTIMETRE', False), ('CENTIMETRES', False)]},
    {"abbrev": 'M', "prefix": False, "forms": [('METER', True), ('METERS', True), ('METRE', True), ('METRES', True), ('MTR', True), ('MTRS', True)]},
    {"abbrev": 'KM', "prefix": False, "forms": [('KILOMETER', False), ('KILOMETERS', False), ('KILOMETRE', False), ('KILOMETRES', False)]},
    {"abbrev": 'UM', "prefix": False, "forms": [('MICRON', False), ('MICRONS', False), ('ΜM', True)]},
    {"abbrev": 'MIL', "prefix": False, "forms": [('MILS', True)]},
    {"abbrev": 'DIA', "prefix": False, "forms": [('DIAMETER', False), ('DIAM', True)]},
    {"abbrev": 'ID', "prefix": False, "forms": [('INNER DIAMETER', False), ('INSIDE DIAMETER', False), ('I.D.', False)]},
    {"abbrev": 'OD', "prefix": False, "forms": [('OUTER DIAMETER', False), ('OUTSIDE DIAMETER', False), ('O.D.', False)]},
    {"abbrev": 'SQIN', "prefix": False, "forms": [('SQ IN', False), ('SQUARE INCH', False), ('SQUARE INCHES', False)]},
    {"abbrev": 'SQFT', "prefix": False, "forms": [('SQ FT', False), ('SQUARE FOOT', False), ('SQUARE FEET', False)]},
    {"abbrev": 'CUIN', "prefix": False, "forms": [('CU IN', False), ('CUBIC INCH', False), ('CUBIC INCHES', False)]},
    {"abbrev": 'CUFT', "prefix": False, "forms": [('CU FT', False), ('CUBIC FOOT', False), ('CUBIC FEET', False), ('CFT', True)]},
    {"abbrev": 'CUYD', "prefix": False, "forms": [('CU YD', False), ('CUBIC YARD', False), ('CUBIC YARDS', False)]},
    {"abbrev": 'GAL', "prefix": False, "forms": [('GALLON', False), ('GALLONS', False), ('GALS', True)]},
    {"abbrev": 'QT', "prefix": False, "forms": [('QUART', False), ('QUARTS', False), ('QTS', True)]},
    {"abbrev": 'PT', "prefix": False, "forms": [('PINT', False), ('PINTS', False), ('PTS', True), ('POINT', True)]},
    {"abbrev": 'L', "prefix": False, "forms": [('LITER', False), ('LITERS', False), ('LITRE', False), ('LITRES', False), ('LTR', True), ('LTRS', True)]},
    {"abbrev": 'ML', "prefix": False, "forms": [('MILLILITER', False), ('MILLILITERS', False), ('MILLILITRE', False), ('MILLILITRES', False), ('MILILITER', False), ('MILILITERS', False), ('MILILITRE', False), ('MILILITRES', False)]},
    {"abbrev": 'FLOZ', "prefix": False, "forms": [('FL OZ', False), ('FLUID OUNCE', False), ('FLUID OUNCES', False)]},
    {"abbrev": 'CC', "prefix": False, "forms": [('CCS', True)]},
    {"abbrev": 'LB', "prefix": False, "forms": [('POUND', False), ('POUNDS', False), ('LBS', False), ('#', True)]},
    {"abbrev": 'OZ', "prefix": False, "forms": [('OUNCE', False), ('OUNCES', False), ('OZS', True)]},
    {"abbrev": 'G', "prefix": False, "forms": [('GRAM', False), ('GRAMS', False), ('GM', True), ('GMS', True)]},
    {"abbrev": 'KG', "prefix": False, "forms": [('KILOGRAM', False), ('KILOGRAMS', False), ('KGS', True), ('KILO', True), ('KILOS', True)]},
    {"abbrev": 'MG', "prefix": False, "forms": [('MILLIGRAM', False), ('MILLIGRAMS', False)]},
    {"abbrev": 'TON', "prefix": False, "forms": [('TONS', True)]},
    {"abbrev": 'EA', "prefix": False, "forms": [('EACH', True)]},
    {"abbrev": 'PC', "prefix": False, "forms": [('PIECE', False), ('PIECES', False), ('PCS', False), ('PCE', True)]},
    {"abbrev": 'PK', "prefix": False, "forms": [('PACK', False), ('PACKS', False), ('PKG', False), ('PKGS', False), ('PAK', True)]},
    {"abbrev": 'BX', "prefix": False, "forms": [('BOX', False), ('BOXES', False), ('BXS', True)]},
    {"abbrev": 'CA', "prefix": False, "forms": [('CASE', True), ('CASES', True), ('CS', True)]},
    {"abbrev": 'BG', "prefix": False, "forms": [('BAG', True), ('BAGS', True)]},
    {"abbrev": 'CT', "prefix": False, "forms": [('CNT', False), ('COUNT', True), ('CTS', True)]},
    {"abbrev": 'PR', "prefix": False, "forms": [('PAIR', False), ('PAIRS', False), ('PRS', True)]},
    {"abbrev": 'DZ', "prefix": False, "forms": [('DOZEN', False), ('DOZ', True)]},
    {"abbrev": 'RL', "prefix": False, "forms": [('ROLL', True), ('ROLLS', True)]},
    {"abbrev": 'SPL', "prefix": False, "forms": [('SPOOL', True), ('SPOOLS', True)]},
    {"abbrev": 'SH', "prefix": False, "forms": [('SHEET', True), ('SHEETS', True)]},
    {"abbrev": 'UNIT', "prefix": False, "forms": [('UNITS', True)]},
    {"abbrev": 'PLY', "prefix": False, "forms": [('PLIES', True)]},
    {"abbrev": 'V', "prefix": False, "forms": [('VOLT', False), ('VOLTS', False), ('VLT', True)]},
    {"abbrev": 'VAC', "prefix": False, "forms": [('V AC', True)]},
    {"abbrev": 'VDC', "prefix": False, "forms": [('V DC', True)]},
    {"abbrev": 'A', "prefix": False, "forms": [('AMPS', False), ('AMPERE', False), ('AMPERES', False), ('AMP', True)]},
    {"abbrev": 'MA', "prefix": False, "forms": [('MILLIAMP', False), ('MILLIAMPS', False)]},
    {"abbrev": 'AH', "prefix": False, "forms": [('AMP HOUR', True), ('AMP HOURS', True)]},
    {"abbrev": 'MAH', "prefix": False, "forms": [('MAHS', True)]},
    {"abbrev": 'W', "prefix": False, "forms": [('WATT', False), ('WATTS', False)]},
    {"abbrev": 'KW', "prefix": False, "forms": [('KILOWATT', False), ('KILOWATTS', False)]},
    {"abbrev": 'KV', "prefix": False, "forms": [('KILOVOLT', False), ('KILOVOLTS', False)]},
    {"abbrev": 'HZ', "prefix": False, "forms": [('HERTZ', False)]},
    {"abbrev": 'KHZ', "prefix": False, "forms": [('KILOHERTZ', False)]},
    {"abbrev": 'MHZ', "prefix": False, "forms": [('MEGAHERTZ', False)]},
    {"abbrev": 'OHM', "prefix": False, "forms": [('OHMS', False)]},
    {"abbrev": 'AWG', "prefix": False, "forms": [('AWGS', True)]},
    {"abbrev": 'GA', "prefix": False, "forms": [('GAUGE', True), ('GAGE', True)]},
    {"abbrev": 'PSI', "prefix": False, "forms": [('PSIG', True)]},
    {"abbrev": 'KPA', "prefix": False, "forms": []},
    {"abbrev": 'MPA', "prefix": False, "forms": []},
    {"abbrev": 'CFM', "prefix": False, "forms": []},
    {"abbrev": 'GPM', "prefix": False, "forms": []},
    {"abbrev": 'GPH', "prefix": False, "forms": []},
    {"abbrev": 'RPM', "prefix": False, "forms": []},
    {"abbrev": 'HP', "prefix": False, "forms": [('HORSEPOWER', False)]},
    {"abbrev": 'BTU', "prefix": False, "forms": [('BTUS', True)]},
    {"abbrev": 'DEG', "prefix": False, "forms": [('DEGREES', False), ('DEGREE', True), ('°', True)]},
    {"abbrev": 'DB', "prefix": False, "forms": [('DECIBEL', True), ('DECIBELS', True)]},
    {"abbrev": 'LM', "prefix": False, "forms": [('LUMEN', False), ('LUMENS', False)]},
    {"abbrev": 'HR', "prefix": False, "forms": [('HOUR', False), ('HOURS', False), ('HRS', True)]},
    {"abbrev": 'MIN', "prefix": False, "forms": [('MINUTE', True), ('MINUTES', True), ('MINS', True)]},
    {"abbrev": 'SEC', "prefix": False, "forms": [('SECOND', True), ('SECONDS', True), ('SECS', True)]},
    {"abbrev": 'TPI', "prefix": False, "forms": [('THREADS PER INCH', False)]},
    {"abbrev": 'NPT', "prefix": False, "forms": []},
    {"abbrev": 'NPTF', "prefix": False, "forms": []},
    {"abbrev": 'MNPT', "prefix": False, "forms": [('MPT', True), ('MIP', True)]},
    {"abbrev": 'FNPT', "prefix": False, "forms": [('FPT', True), ('FIP', True)]},
    {"abbrev": 'NPS', "prefix": False, "forms": []},
    {"abbrev": 'UNC', "prefix": False, "forms": []},
    {"abbrev": 'UNF', "prefix": False, "forms": []},
    {"abbrev": 'NC', "prefix": False, "forms": []},
    {"abbrev": 'NF', "prefix": False, "forms": []},
    {"abbrev": 'DR', "prefix": False, "forms": [('DRIVE', True)]},
    {"abbrev": 'FL', "prefix": False, "forms": [('FLUTE', True), ('FLUTES', True)]},
    {"abbrev": 'T', "prefix": False, "forms": [('TOOTH', True), ('TEETH', True)]},
    {"abbrev": 'GRIT', "prefix": False, "forms": []},
    {"abbrev": 'MESH', "prefix": False, "forms": []},
    {"abbrev": 'CAL', "prefix": False, "forms": []},
    {"abbrev": 'GR', "prefix": True, "forms": [('GRADE', False)]},
]

# Colours and their abbreviations. The list headings are terms too.
COLORS = """
COLOR, FOREST GREEN, ROYAL BLUE, NAVY BLUE, TURQUOISE, SKY BLUE, ORANGE, PURPLE, SILVER, VIOLET, YELLOW, AMBER, BEIGE,
BLACK, BROWN, CLEAR, GREEN, OLIVE, PEARL, WHITE, BLUE, GOLD, GRAY, GREY, LIME, NAVY, PINK, RED, TAN
"""
COLOR_ABBREVIATIONS = """
COLOR_ABBREV, FST GRN, NBLU, RBLU, SBLU, AMB, BEI, BLK, BLU, BRN, CLR, GLD, GRN, GRY, OLV, ORG, PNK, PRL, PUR, RED, SLV,
TAN, TRQ, VLT, WHT, YLW, BK, BL, CH, GY, LM, NV, OG, OR, RD, SV, WH, YW
"""

# Clothing sizes, then trouser lengths, then waists.
CLOTHING_SIZES = """
SIZES, MEDIUMLARGE, SMALL, MEDIUM, LARGE, EXTRALARGE, EXTRA LARGE, XXS, XS, S, ST, SM, M, MED, MD, MT, L, LRG, LG, LT,
X, XL, XLT, XLRG, XXL, 2XL, 2X, 2XLT, XXXL, 3X, 3XL, 3XLT, XXXXL, 4X, 4XL, 4XLT, XXXXXL, 5X, 5XL, 5XLT,
28L, 29L, 30L, 31L, 32L, 33L, 34L, 35L, 36L, 37L, 38L, 39L, 40L, 41L, 42L, 43L, 44L, 45L, 46L, 47L, 48L, 49L, 50L,
51L, 52L, 53L, 54L, 55L, 56L, 57L, 58L,
X28, X29, X30, X31, X32, X33, X34, X35, X36, X37, X38, X39, X40, X41, X42, X43, X44, X45, X46, X47, X48, X49, X50,
X51, X52, X53, X54, X55, X56, X57, X58
"""

# Record markers; ``*`` stands for any run of characters inside the marker.
MARKERS = ("(DV)", "[DV]", "(DC)", "[DC]", "(BP)", "(R-*)")
PLACEHOLDERS = ("<SIZE>", "<COLOR>")


def terms_of(text: str) -> list[str]:
    """Comma-separated terms, without blanks and repeats, in order."""
    return list(dict.fromkeys(t for t in (" ".join(p.split()) for p in text.split(",")) if t))


def default_colors() -> list[str]:
    return list(dict.fromkeys(terms_of(COLORS) + terms_of(COLOR_ABBREVIATIONS)))


def default_sizes() -> list[str]:
    return terms_of(CLOTHING_SIZES)


@dataclass(frozen=True)
class CleaningSettings:
    """Lists and parameters of the 13 cleaning steps."""

    units: list[dict] = field(default_factory=lambda: [dict(u) for u in UNITS])
    colors: list[str] = field(default_factory=default_colors)
    sizes: list[str] = field(default_factory=default_sizes)
    markers: tuple[str, ...] = MARKERS
    field_width: int = 24
    repair_min_count: int = 3
    keep_word_forms: bool = True
    keep_measurements: bool = True
    keep_common_words: int | None = 50
    punctuation_mode: str = "delete"
    min_word_descriptions: int = 5
    collapse_placeholders: tuple[str, ...] = PLACEHOLDERS
    append_fields: dict = field(default_factory=dict)
    append_nulls_as_none: bool = True

    def as_dict(self) -> dict:
        """For JSON."""
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> CleaningSettings:
        """From the stored dict; JSON knows no tuples."""
        units = [{**u, "forms": [tuple(f) for f in u["forms"]]} for u in values["units"]]
        fixed = {n: tuple(values[n]) for n in ("markers", "collapse_placeholders")}
        return cls(**{**values, **fixed, "units": units})
