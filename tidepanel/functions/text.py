"""Filing classification and symbol helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Form types and their category.
FORM_CATEGORIES = {
    "8-K": "hecho_relevante",
    "6-K": "hecho_relevante",
    "10-Q": "resultados_trimestrales",
    "10-K": "resultados_anuales",
    "20-F": "resultados_anuales",
    "S-1": "emision_capital",
    "424B2": "emision_deuda",
    "424B5": "emision_deuda",
    "SC 13D": "cambio_control_accionario",
    "SC 13G": "participacion_significativa",
    "DEF 14A": "asamblea_accionistas",
}

# Whole-word alternatives and their category; the first match wins.
KEYWORD_CATEGORIES = (
    ("earnings|results|resultados|quarter|trimestr", "resultados_trimestrales"),
    ("guidance|outlook|proyecc", "revision_guidance"),
    ("dividend|dividendo|buyback|recompra", "retorno_al_accionista"),
    ("notes|bond|tender offer|obligaciones negociables|deuda", "financiamiento"),
    ("acquisition|merger|adquisic|fusion", "fusiones_adquisiciones"),
    ("litigation|lawsuit|juicio|demanda|ruling|fallo", "litigio"),
    ("export control|sanction|tariff|arancel|restricc", "regulatorio_comercial"),
    ("ceo|cfo|board|director|renunci|resign", "cambio_directivo"),
)

# Alternatives that are stems; as whole words they only match themselves.
_STEMS = ("trimestr", "proyecc", "adquisic", "renunci", "restricc")

RELEVANT_FACT, UNCLASSIFIED = "hecho_relevante", "sin_clasificar"

# Symbols of the second vendor.
SECONDARY_SYMBOLS = {
    "NVDA": "nvda.us", "AAPL": "aapl.us", "MSFT": "msft.us", "GOOGL": "googl.us", "AMZN": "amzn.us",
    "META": "meta.us", "AVGO": "avgo.us", "TSLA": "tsla.us", "MU": "mu.us", "AMD": "amd.us",
    "YPF": "ypf.us", "^NDX": "^ndx", "^GSPC": "^spx",
}


_BORDER = 1_000  # no keyword is nearly as long


def _words(alternatives: str, stems: bool) -> str:
    if stems:
        parts = [f"{a}\\w*" if a in _STEMS else a for a in alternatives.split("|")]
        alternatives = "|".join(parts)
    # (?U): word boundaries know accented letters.
    return f"(?iU)\\b({alternatives})\\b"


def keyword_category(text: Column, stems: bool = False) -> Column:
    """First keyword category found in the text, else NULL.

    Most texts hold no keyword at all: one pass over all words together rules
    them out before the ordered rules are tried.
    """
    every = "|".join(words for words, _ in KEYWORD_CATEGORIES)
    out = F.when(~text.rlike(_words(every, stems)), F.lit(None).cast("string"))
    for words, category in KEYWORD_CATEGORIES:
        out = out.when(text.rlike(_words(words, stems)), F.lit(category))
    return out


def classify_filing(form: Column, title: Column, stems: bool = False, by_title: Column | None = None) -> Column:
    """Category by form; relevant facts are refined by the title, unknown forms
    are searched in form and title together.

    ``by_title``: the title's ``keyword_category``, if it is known already; a
    title under several forms is then searched once.  Without a keyword in the
    title, one can only lie in the form or across their border.
    """
    title = F.coalesce(title, F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in FORM_CATEGORIES.items() for x in pair])
    base = F.try_element_at(known, F.upper(F.trim(form)))
    by_both = keyword_category(F.concat_ws(" ", form, title), stems)
    if by_title is None:
        by_title = keyword_category(title, stems)
    else:
        every = "|".join(words for words, _ in KEYWORD_CATEGORIES)
        border = F.concat_ws(" ", form, F.substring(title, 1, _BORDER))
        by_both = F.when(by_title.isNotNull() | border.rlike(_words(every, stems)), by_both)
    return (F.when(base == RELEVANT_FACT, F.coalesce(by_title, base))
            .when(base.isNotNull(), base)
            .otherwise(F.coalesce(by_both, F.lit(UNCLASSIFIED))))


def root_symbol(ticker: Column) -> Column:
    """Upper-case symbol without its exchange suffix."""
    return F.split(F.upper(ticker), "\\.")[0]


def clean_symbol(raw: Column) -> Column:
    """Trimmed upper-case symbol; NULL unless purely alphabetic."""
    s = F.upper(F.trim(raw))
    return F.when(s.rlike("^\\p{L}+$"), s)


def secondary_symbol(ticker: Column) -> Column:
    """Symbol of the second vendor; unknown tickers stay NULL, never guessed."""
    known = F.create_map(*[F.lit(x) for pair in SECONDARY_SYMBOLS.items() for x in pair])
    return F.try_element_at(known, ticker)
