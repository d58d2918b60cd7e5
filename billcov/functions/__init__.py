"""Column-level helpers: all return ``Column`` expressions built from Spark's built-ins."""

from billcov.functions.text import (  # noqa: F401
    contains_flag,
    first_char_is,
    join_nonempty,
    remove_first,
    remove_words,
    text_before,
    word_tokens,
)
from billcov.functions.numeric import percent_text, round_half_even  # noqa: F401
from billcov.functions.sizing import sized_broadcast  # noqa: F401
