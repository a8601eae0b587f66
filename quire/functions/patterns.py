"""Text patterns, in a dialect that Spark and DuckDB read alike.

``(?i)`` folds ASCII letters only in Java, so accented letters stand in pairs.
"""

QUESTION = r"^([0-9]{3})[.]\s*(.+)"
ALTERNATIVE = r"^([a-eA-E])[)]\s*(.+)"
ROMAN = r"^([IVXLCDM]{1,7})\s*[–—-]\s*(.+)"
BULLETS = "•◦▪■□◆◇‣⁃"
DASHES = "−–—-"
BULLET = rf"^([{BULLETS}])\s*(.*)"
DASH = rf"^([{DASHES}])\s+(.+)"
WORD = "0-9A-Za-z_ªºÀ-ÖØ-öø-ÿ"
ARTICLE = r"(?i)^art[.]\s*[0-9]+[ºo°]?[.]?(\s|$)"
LEGAL_ITEM = rf"(?i)^(§\s*[0-9]+[ºo]?|par[áÁ]grafo\s+[úÚ]nico)($|[^{WORD}])"
ANSWER = r"(?i)^(letra\s+[a-e]|certo|errado)[.]?$"
_CALL = r"(dica|exemplo|obs[.]?|aten[çÇ][ãÃ]o|importante)"
CALL_INLINE = rf"(?i)^{_CALL}\s*:\s*(.+)$"
CALL_LABEL = rf"(?i)^{_CALL}\s*:?$"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
LOWER = "a-zà-öø-ÿ"
TRAILING_HYPHEN = rf"[{LETTER}]\s*-\s*$"
SPACED_FRAGMENT = rf"(^|[^{LETTER}])[{LETTER}]{{2,}}\s+-\s+[{LOWER}]{{2,}}($|[^{LETTER}])"
NUMBERING = r"^[0-9]+([.][0-9]+)+[.]\s+"
COUNTER = r"[0-9]+\s+de\s+[0-9]+"
TERMINAL = r"[.!?;:]$"
CLOSERS = r"[\"”’)\]]+$"
LOWER_START = rf"^[\"“‘(\[]*[{LOWER}]"
EMBEDDED_MARKER = r"(^|\s)([•−◦▪■□◆◇‣⁃])\s+"
EDGE_TOKEN = r"^([VFC]|[pqrPQR]|[¬~]?\s*[pqrPQR]|[pqrPQR]\s*[∧∨→↔]|[0-9]+)$"
TABLE_CAPTION = r"(?i)(^|[^A-Za-z0-9_])tabela\s+[0-9]+\s*:"
ASSERTION_TAIL = r"(?i)(^|\W)(assinale|marque|supondo que|nota-se, ent[ãÃ]o|para que o operador)(\W|$)"
TABLE_KEYWORDS = r"[Tt]abela|[Qq]uadro"
CAPITALS = "A-ZÁÉÍÓÚÂÊÔÃÕÇ"
CAPITAL = f"[{CAPITALS}]"
#: Two equal words of capitals side by side (Java only: boundary in Unicode, back reference).
TWICE = rf"(?U)\b([{CAPITALS}]{{5,}})\s+\1\b"
AUTHOR = rf"^[{CAPITALS} ]{{5,60}}$"
SUBBULLETS = "◦▪■□◆◇‣⁃"
