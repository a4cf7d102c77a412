"""Scalar functions over label and SMILES text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes that label files put around text.
LABEL_ESCAPES = ["^", "\\s", "\\n", "\\S", "\\r", "\r"]
#: Labels that name no group.
PLAIN_LABELS = ["a", "s", "q", "g", "e", "h", "j", "i", "I", "j2"]
#: Characters that drawn labels are mostly made of.
LABEL_CHARACTERS = "CcNHOohn"
#: Elements that count as exotic.
EXOTIC_ATOMS = [
    "He", "Be", "B", "Ne", "Na", "Al", "Ar", "K", "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Kr", "Rb",
    "Sr", "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn", "Sb", "Te", "Xe", "Cs", "Ba", "La", "Ce", "Pr", "Nd", "Pm", "Sm",
    "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po", "At", "Rn",
    "Fr", "Ra", "Ac", "Th", "Pa", "U", "Np", "Pu", "Am", "Cm", "Bk", "Cf", "Es", "Fm", "Md", "No", "Lr", "Rf", "Db", "Sg", "Bh", "Hs", "Mt", "Ds",
    "Rg", "Cn", "Uut", "Fl", "Uup", "Lv", "Uus", "Uuo",
]
#: Fixed value: the published pattern of SMILES tokens.
SMILES_TOKEN = r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>>?|\*|\$|\%[0-9]{2}|[0-9])"


def clean_label(text: Column) -> Column:
    for x in LABEL_ESCAPES:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def valid_label(text: Column, smiles: Column) -> Column:
    """Whether a label and its SMILES name one group."""
    bad = (text == "O(H)") | text.contains(":") | text.contains("~") | (text == "") | text.isin(PLAIN_LABELS) | text.contains("\ufffd")
    return ~bad & ~smiles.contains(".") & (F.translate(smiles, "*()", "") != "")


def caption_flag(text: Column, score: Column) -> Column:
    """What a text found in a drawing is: remove (and filter), filter or null; the first rule that holds decides."""
    n = F.length(text)
    kept = F.length(F.regexp_replace(text, f"[^{LABEL_CHARACTERS}]", ""))
    commas = n - F.length(F.replace(text, F.lit(","), F.lit("")))
    number = text.rlike("^[0-9]+$") & text.rlike("[1-9]")
    rules = F.when((n > 10) & (kept < n / 3), "remove").when(n > 10, "filter").when((n > 2) & (kept < n / 2), "filter")
    rules = rules.when(number & (score >= 0.85), "filter").when((n > 2) & (commas > 2), "filter")
    return rules.when((n == 2) & text.rlike("[():]"), "filter")


def caption_decision(rows: DataFrame, image: str, order: str) -> DataFrame:
    """(image, filter_masks, removed) of the texts (order, word, score) found in each drawing: whether its small masks are to be filtered, and the places,
    in order, of the texts to remove."""
    flag = caption_flag(F.col("word"), F.col("score"))
    flagged = rows.select(image, order, flag.alias("flag"))
    removed = F.array_sort(F.collect_list(F.when(F.col("flag") == "remove", F.col(order))))
    return flagged.groupBy(image).agg(F.bool_or(F.col("flag").isNotNull()).alias("filter_masks"), removed.alias("removed"))


def fused_label(parts: Column) -> Column:
    """The one label that the parts of a crop make: SO2 or CF2, else null."""
    has = lambda x, ys: F.array_contains(parts, x) & F.arrays_overlap(parts, F.array(*[F.lit(y) for y in ys]))
    return F.when(has("C", ["F2", "Fz"]), "CF2").when(has("S", ["O2", "02", "Oz", "0z"]), "SO2")


def symbol_part(text: Column, part: str) -> Column:
    """symbol, charge or isotope of a composite symbol such as `N,1` or `X;13`."""
    if part == "symbol":
        return F.regexp_extract(text, "^([^,;]*)", 1)
    found = F.regexp_extract(text, f"{',' if part == 'charge' else ';'}(-?[0-9]+)", 1)
    return F.when(found != "", found.cast("int"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The last part of a path without its last four characters."""
    name = basename(path)
    return F.substring(name, F.lit(1), F.greatest(F.length(name) - 4, F.lit(0)))


def preprocessed_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_preprocessed.png"))


def has_stereo(smiles: Column) -> Column:
    return smiles.contains("@")


def has_exotic_atom(smiles: Column) -> Column:
    """Whether a token, without brackets, H and @, is an exotic element."""
    tokens = F.transform(F.regexp_extract_all(smiles, F.lit(SMILES_TOKEN), F.lit(1)), lambda t: F.regexp_replace(t, r"[\[\]H@]", ""))
    return F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in EXOTIC_ATOMS]))
