"""Operator 5: quality rules, line first.

Each line is judged by itself: by its punctuation, as navigation, and as boilerplate, by marks that
hold in any language (symbols, separators, how it ends, runs of bare entries) and by phrases of
four. Lines that fail are removed; a document is rejected if it loses too large a share of its text, or by the base
rules of the contract. Only DataFrame functions run here; nothing is shuffled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import BLANKS, words

SYMBOLS = "#*$%&|<>"
#: Phrases of lines that are no text of their own, in English, French, German and Spanish. Fixed values, matched in lower case.
BOILERPLATE = (
    r"all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|enable javascript|lorem ipsum"
    r"|sign (in|up)|log ?in to|subscribe to (our|the)|click here|skip to (main )?content|powered by|share (this|on)"
    r"|tous droits r.serv.s|mentions l.gales|politique de confidentialit|accepter (tous )?les cookies|se connecter|s.inscrire|cliquez ici"
    r"|alle rechte vorbehalten|datenschutzerkl.rung|nutzungsbedingungen|cookies akzeptieren|hier klicken|jetzt anmelden"
    r"|todos los derechos reservados|pol.tica de privacidad|t.rminos y condiciones|aceptar (todas las )?cookies|iniciar sesi.n|haga clic aqu"
)
NAVIGATION = (
    r"(^|[\s|>»•/])(home|about( us)?|contact( us)?|login|register|menu|search|next|previous|back to top|sitemap"
    r"|accueil|recherche|suivant|plan du site|startseite|kontakt|suche|weiter|impressum|inicio|contacto|buscar|siguiente|mapa del sitio)\s*([|>»•/]|$)"
)
#: What a text must contain somewhere for a line to match: looked for once a text, before any line.
BOILERPLATE_HINTS = (
    "all rights", "terms of ", "policy", "cookies", "javascript", "lorem ipsum", "sign in", "sign up", "log in to", "login to", "subscribe to", "click here", "skip to ", "powered by", "share this", "share on",
    "tous droits", "mentions l", "confidentialit", "connecter", "inscrire", "cliquez ici", "vorbehalten", "datenschutz", "nutzungsbed", "hier klicken", "jetzt anmelden", "derechos reservados", "privacidad", "condiciones", "iniciar sesi", "clic aqu",
)
NAVIGATION_HINTS = (
    "home", "about", "contact", "login", "register", "menu", "search", "next", "previous", "back to top", "sitemap",
    "accueil", "recherche", "suivant", "plan du site", "startseite", "kontakt", "suche", "weiter", "impressum", "inicio", "buscar", "siguiente", "mapa del sitio",
)
#: What stands between the entries of a menu, in any language.
SEPARATORS = "|•·›→"
#: What a line of prose ends with. A line of up to SHORT parts without it is an entry of a list if RUN such lines follow each other.
END_MARKS = r"""[.!?…:;,"'”’»)\]。！？]$"""
SHORT, RUN = 3, 3
#: Bits of a window's hash that are looked at; fewer in tests.
HASH_BITS = 64
BLANK = r"[\x20\x09-\x0D]"
#: A document that loses more than this share of its word characters is rejected.
MAX_LOST = 0.5


def _repeat_words(w: Column) -> Column:
    """Words covered by the three-word windows that occur at least twice.

    Windows are compared by a hash of 64 bits less those that number the words of the text; sorting
    the packed longs brings equal windows together in their order in the text. Where neighbours of
    equal hash differ in their words, the text's windows are sorted by their words instead.
    """
    n = F.size(w) - 2
    bits = F.ceil(F.log2(n + 1)).cast("int")
    cut = lambda h: h if HASH_BITS == 64 else F.shiftrightunsigned(h, 64 - HASH_BITS)
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: cut(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.struct(bits.alias("bits"), hashes.alias("h"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the base measures. Rows that share an id are rows of their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("*", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(
        "doc_id", "text", F.size("w").cast("long").alias("n_words"), _word_chars(F.col("text")).alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), lines.alias("lines"),
        F.when(F.size("w") > 2, _repeat_words(F.col("w"))).alias("r"), "w",
    )
    # Below the bits that number words: the place; above: the hash. sort_array sorts longs as they are.
    packed = F.sort_array(F.transform("r.h", lambda h, i: F.call_function("shiftleft", h, F.col("r.bits")).bitwiseOR(i.cast("long"))))
    base = base.withColumn("s", packed)
    over = lambda x: F.call_function("shiftright", x, F.col("r.bits"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("r.bits")) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")
    alike = lambda x, y: functools.reduce(lambda a, b: a & b, [F.get("w", place(x) + k) == F.get("w", place(y) + k) for k in range(3)])
    hashed = lambda of, x, j: F.coalesce(over(F.get(of, j)) == over(x), F.lit(False))
    twice = F.filter("s", lambda x, i: hashed("s", x, i - 1) | hashed("s", x, i + 1))
    base = base.withColumn("twice", F.when(F.size("s") > 0, twice))
    # A run of equal hashes is whole in `twice`, so unlike windows of one hash are neighbours somewhere in it.
    unlike = F.exists(F.sequence(F.lit(1), F.size("twice") - 1), lambda i: hashed("twice", F.get("twice", i), i - 1) & ~alike(F.get("twice", i - 1), F.get("twice", i)))
    base = base.withColumn("unlike", F.when(F.size("twice") > 1, unlike).otherwise(F.lit(False)))
    window = lambda i: F.struct(*[F.get("w", i + k).alias(f"w{k}") for k in range(3)], i.cast("long").alias("i"))
    base = base.withColumn("v", F.when(F.col("unlike"), F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), window))))
    equal = lambda x, j: F.coalesce(functools.reduce(lambda a, b: a & b, [F.get("v", j)[f"w{k}"] == x[f"w{k}"] for k in range(3)]), F.lit(False))
    worded = F.transform(F.filter("v", lambda x, i: equal(x, i - 1) | equal(x, i + 1)), lambda x: x["i"])
    at = F.when(F.col("unlike"), worded).otherwise(F.transform("twice", lambda x: x.bitwiseAND(mask)))
    base = base.withColumn("at", F.sort_array(at))
    # A window covers three words, or as many as there are to the next window's beginning.
    gaps = F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3))))
    base = base.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    return base.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("r", "s", "twice", "unlike", "v", "at", "w")


def line_fault(x: Column, tokens: Column, phrases: bool = True) -> Column:
    """Why a line with a word fails: 'symbols', 'shouting', 'bars', 'navigation', 'boilerplate', or null.

    tokens: its parts between blanks. phrases: whether to look for navigation and boilerplate.
    """
    marked = x.rlike(f"[#*$%&!{SEPARATORS}]")
    count = lambda chars: F.regexp_count(x, F.lit(f"[{chars}]"))
    fault = (
        F.when(marked & (5 * count("#*$%&") > 2 * tokens), "symbols")
        .when(marked & (5 * count("!") > 2 * tokens), "shouting")
        .when(marked & (5 * count(SEPARATORS) > tokens), "bars")
    )
    if phrases:
        fault = fault.when((tokens <= 12) & F.lower(x).rlike(NAVIGATION), "navigation").when((tokens <= 30) & F.lower(x).rlike(BOILERPLATE), "boilerplate")
    return fault


def _word_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long")


def apply_rules(docs: DataFrame, max_lost: float = MAX_LOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed, lost (word characters removed), cleaned_text, kept.

    A null text counts as the empty text, which has no words and fails the base rules. Every row
    of docs, repeated ones too, comes back once; an empty table gives an empty result; other
    columns are not read.
    """
    base = measured(docs, id_col, text_col)
    hinted = base.withColumn("low", F.lower("text"))
    hint = functools.reduce(lambda a, b: a | b, [F.contains("low", F.lit(h)) for h in (*NAVIGATION_HINTS, *BOILERPLATE_HINTS)])
    hinted = hinted.withColumn("hinted", hint).drop("low", "text")
    hinted = hinted.withColumn("lines", F.transform("lines", lambda x: F.struct(x.alias("x"), F.regexp_count(F.btrim(x, F.lit(BLANKS)), F.lit(r"[^ \t]+")).alias("n"))))
    bare = F.transform("lines", lambda s: (s["n"] <= SHORT) & ~F.btrim(s["x"], F.lit(BLANKS)).rlike(END_MARKS))
    hinted = hinted.withColumn("bare", bare).withColumn("listed", F.aggregate("bare", F.lit(0), lambda a, x: a + x.cast("int")) >= RUN)
    in_run = lambda i: functools.reduce(lambda a, b: a | b, [functools.reduce(lambda a, b: a & b, [F.coalesce(F.get("bare", i - k + j), F.lit(False)) for j in range(RUN)]) for k in range(RUN)])
    good = lambda phrases: F.transform(F.filter("lines", lambda s, i: line_fault(s["x"], s["n"], phrases).isNull() & ~(F.col("listed") & in_run(i))), lambda s: s["x"])
    # The hint is asked for beside the lambdas: within them it would be looked for again for each line.
    judged = hinted.withColumn("cleaned_text", F.array_join(F.when(F.col("hinted"), good(True)).otherwise(good(False)), "\n"))
    lost = F.col("word_chars") - _word_chars(F.col("cleaned_text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        lost.alias("lost"), "cleaned_text", (~failed & (lost <= max_lost * F.col("word_chars"))).alias("kept"),
    )
