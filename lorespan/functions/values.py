"""Lists, patterns and defaults that decide results.

Everything in this file must keep its exact value; logic lives elsewhere.
"""

# --- fixed values: white space ------------------------------------------------
# The characters Python's str.strip() removes, as a trim set and as a regular
# expression class that Java and RE2 read alike.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# --- fixed values: markdown ---------------------------------------------------
FENCE_MARK = "```"
HEADER_START = rf"\n(?=#{{2,3}}[{WS}])"
HEADER_LINE = rf"^#{{2,3}}[{WS}]+[^\n]+"
PARAGRAPH_BREAK = r"\n\n+"
INTRODUCTION = "Introduction"

# --- fixed values: language labelling -----------------------------------------
LANGUAGE_MIN_CHARS = 30
LANGUAGE_THRESHOLD = 5
CLEANING_STEPS = [
    (r"```[\s\S]*?```", ""),
    (r"`[^`]+`", ""),
    (r"\[[^\n]*?\]\([^\n]*?\)", ""),
    (r"[#*|>_\-=]", " "),
    (rf"[^{WS}]+/[^{WS}]+", ""),
    (r"\$[0-9.,]+", ""),
    (rf"[{WS}]+", " "),
]
MARKERS = {
    "hu": [
        "és|vagy|hogy|nem|van|egy|volt|lett|csak|már|még|mint|után|alatt",
        "pedig|tehát|viszont|mert|mivel|ezért|ugyanis|továbbá",
        "amikor|ahol|amelyik|ahogy|amíg|ameddig",
        "kötelező|kritikus|fontos|szükséges|lehetséges",
    ],
}
SOURCE_LANGUAGE = "hu"
TARGET_LANGUAGE = "en"

# --- fixed values: scan rules -------------------------------------------------
INCLUDE = ["**/*.md"]
EXCLUDE_DIRS = [
    ".git", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build",
    ".next", "target", ".cache", ".idea", ".vscode", ".ipynb_checkpoints",
    ".mypy_cache", ".ruff_cache", ".pytest_cache", "knowledge", ".mempalace",
    "mlruns", "data",
]
EXCLUDE_FILES = ["manifest.json"]
ALLOW_PREFIXES = ["knowledge/diary"]

# --- fixed values: sizes ------------------------------------------------------
MAX_TOKENS = 1500
MIN_TOKENS = 50
CHARS_PER_TOKEN = 4
STORED_PREVIEW = 300
SHOWN_PREVIEW = 200
TOP_K = 10
WEAK_SCORE = 0.3
MTIME_TOLERANCE = 0.001
BATCH_DOCUMENTS = 20
