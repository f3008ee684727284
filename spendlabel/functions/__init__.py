from .parse import (form_amount, iso_date_text, staging_amount,
                    staging_date)
from .text import (bucket_of, clean_field, collapse_ws_keep_case, ngram_array, normalized,
                   row_id_of, text_of, title_words, tokens_of, trim_ws)

__all__ = [
    "form_amount", "iso_date_text", "staging_amount", "staging_date",
    "bucket_of", "clean_field", "collapse_ws_keep_case", "ngram_array", "normalized",
    "row_id_of", "text_of", "title_words", "tokens_of", "trim_ws",
]
