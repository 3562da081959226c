"""Column expression builders (JVM-side, codegen-friendly)."""
from .hashing import fold_of, hash32, hash_unit
from .numeric import (NUMBER_PATTERN, clip0, finite, format_g, num, parse_number,
                      parse_user_number, safe_div, to_number)
from .text import (MISSING_TOKENS, blank_to_null, casefold, clean_text, contains_folded,
                   is_missing, is_missing_any, match_key, strip_ws)

__all__ = [
    "fold_of", "hash32", "hash_unit", "NUMBER_PATTERN", "clip0", "finite", "format_g", "num",
    "parse_number", "parse_user_number", "safe_div", "to_number", "MISSING_TOKENS",
    "blank_to_null", "casefold", "clean_text", "contains_folded", "is_missing",
    "is_missing_any", "match_key", "strip_ws",
]
