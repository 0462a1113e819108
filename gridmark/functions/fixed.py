"""What the drawings' notation and the results depend on."""

# Patterns of the notation.
SIZES = r"(?:10|15|20|25|30|35|45|55)M"
INCH = r"\"|”|″|''|’’"
TAG_INCH = r"[\"”″]"
COUNTED = rf"(?<![\d.@])(\d+)\s*-\s*({SIZES})\b"
SPACED = rf"({SIZES})\s*@\s*(\d+(?:\.\d+)?)\s*({INCH}|mm)?"
AT = rf"@\s*(\d+(?:\.\d+)?)(?:\s+(\d+)/(\d+))?\s*({INCH}|mm)?"
SHOP_BAR = rf"^(?:([A-ZÀ-Ý][A-ZÀ-Ý\-]*)\s*[:.]\s*)?(?:(\d+)\s*[xX]\s*)?(\d+)\s+({SIZES})\s*([^\s@]*)\s*(.*)$"
TAG_COUNTED = r"(\d+)\s*-\s*(\d{2}M)"
TAG_SPACED = rf"(\d{{2}}M)\s*@\s*(\d+(?:\.\d+)?)\s*({TAG_INCH})?"
TABLE_BAR = r"^(VERT|[ÉE]TRI|[ÉE]PIN)\.?:\s*(\d+)\s+(\d{2}M)\s+(\S+)\s*(.*)$"
TABLE_SPACING = rf"@\s*(\d+(?:\.\d+)?)(?:\s+(\d+)/(\d+))?\s*(?:{TAG_INCH}|'')"
MARK_LENGTH = r"(\d{1,3})-(\d{1,2})\.?$"
DETAIL_NAME = r"([A-Z]{1,2}(?:\.\d)?)\s*[-/]\s*(\d{1,2}(?:\.\d)?[A-Z]?)"
DETAIL_BAR = rf"(?:(\d+)\s*[xX]\s*)?(\d+?)\s*({SIZES})\b\s*([^\s@]+)?"
LOOSE_BAR = rf"^({SIZES})\s+([^\s@]+)"
DETAIL_SPACING = r"(\d+)?\s*@\s*(\d+(?:\.\d+)?)\s*(\"|”|″|'')?"
DETAIL_AT = r"@\s*(\d+(?:\.\d+)?)\s*(\"|”|″|'')?"
POSITION = r"COL\s*:\s*(.+)"
SHEET = r"S-?\s?\d{3}"
COLUMN_SHEET = r"S-?\s?5\d\d"
SERIES_NUMBER = r"S-?\s?\d{3}[A-Z]?(?![A-Za-zÀ-ÿ])"
GRID_LABEL = r"([A-Z])\1?(\.\d)?|\d{1,2}(\.\d)?[A-Z]?"
MARK = r"[A-Z](\.\d)?-\d{1,2}(\.\d)?"
ELEVATION = r"^[ÉE]L\.?:"
ROLE = r"^[A-ZÀ-Ý]{3,}\d?(?=\s|$)"
TYPE_ROW = r"TYPE\s+([A-Z]\d?)"
HEADERS = {"LONG": r"ARM\.?\s*LONG", "TRAN": r"ARM\.?\s*TRANS"}
COLUMN_HEAD = r"COL(?:ONNES?)?\.?\s+(.+)"
FOOTING_ROLES = ("LONG", "TRAN")
RAFT = r"RADIER\s*-?\s*#\s*(\d+)"
LAYER = r"RANG\s*(\d)"
MAT = r"\b(HAUT|BAS)\b"
SPAN_TITLE = r"([A-Z]{1,2}-?\d{2,4}[A-Z]?)\s*[-:]\s*\d"
WALL_TITLE = r"[ÉE]L[ÉE]VATION\b(?:.*?\bMUR\s+(\w+))?"
WALL_TAG = r"ARM\.?\s*:"
WALL_WEB = r"([HV])\.?\s*:\s*(.+)"
SLAB_CALLOUT = r"(\d+)\s*\(\s*(\d+)\s*\)\s*(?:-\s*(\d\d)\s*M)?"
SLAB_TYPICAL = rf"TYPIQUE.*?({SIZES})"
SLAB_LABEL = r"(\d+)\s+((10|15|20|25|30|35|45|55)(?:M\s*|[A-Z]{1,3})\d[\w\-]*)"
SLAB_BAND = r"(\d+)\s*m\.?\s*b\.?"
DERIVED_NAME = r"([A-Z])(?:\.(\d))?-(\d{1,2})(?:\.(\d))?"
CORRECTION = r"#?(\d+)\s*=\s*(.*)"
MISSED = r"missed\s+([A-Z]\d+)\s*:\s*(.+)"

# Words that tell what a file's drawings detail, by kind.
KINDS = {
    "colonne": ("colon",),
    "fondation": ("fondation", "semelle", "radier", "empattement"),
    "poutre": ("poutre",),
    "mur": ("mur", "refend", "cisail", "contrevent"),
    "dalle": ("dalle",),
}

# Distances, in points unless said otherwise.
ON_GRID, LEADER_HOPS, SNAP, TAG_REACH, LEADER_LENGTH, PAIR_REACH = 20, 4, 1.5, 22, 400, 150
TITLE_ROW_GAP, MARK_ROW_GAP, SAME_ROW, SHORTEST_ROW = 40, 8, 15, 3
COLUMN_REACH, MIN_COLUMN, MARGIN, TITLE_HEIGHT, LETTER_REACH = 150, 8, 60, 1.3, 160
SLAB_REACH_BAYS, TOUCHING_HEIGHTS, CLOSE_TENTHS = 2.0, 0.6, 2
OCR_DPI, TILE, TILE_OVERLAP, MIN_WORDS, REVIEW_CELL, NEAR_WORD, CROP_EDGE = 300, 2000, 500, 20, 216, 3, 4
INCH_MM, BARE_INCHES_TO, TOLERANCE = 25.4, 24, 0.05
