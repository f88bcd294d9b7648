"""Character classes spelled out, so that patterns mean the same in every JDK.

``\\s`` in the source semantics is Unicode white space and word boundaries are ASCII; Java's defaults
differ on both counts, so patterns are written with ``{S}``, ``{W}`` and ``{B}`` placeholders and expanded here.
"""

from __future__ import annotations

# The white-space code points matched by the source semantics.
_CODES = ("00A0", "1680", "2000-200A", "2028", "2029", "202F", "205F", "3000", "FEFF")
_UNICODE = "".join("-".join("\\u" + c for c in code.split("-")) for code in _CODES)
SPACE = "[\\s" + _UNICODE + "]"
NON_SPACE = "[^\\s" + _UNICODE + "]"
WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """Expand ``{S}`` (white space), ``{NS}`` (its complement), ``{W}`` (ASCII word character), ``{B}`` (word boundary).

    Hot patterns start with a look-ahead for their possible first characters and use ``(?<!{W})`` where the
    next character is known to be a word character: same matches, far fewer attempts.
    """
    body = pattern.replace("{NS}", NON_SPACE).replace("{W}", WORD).replace("{S}", SPACE).replace("{B}", BOUNDARY)
    return ("(?i)" if ignore_case else "") + body
