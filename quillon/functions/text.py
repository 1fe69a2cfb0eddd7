"""Text as Column functions: folding, tokens, lines. Each has its DuckDB spelling for the oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)*"
#: The same pattern for Spark, which never goes back into a run that it has read.
TOKEN_RUN = r"[\p{L}\p{N}]++(?:[-_][\p{L}\p{N}]++)*+"
#: Latin letters with a mark, and the letters under them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
_hidden = "\u00ad\u200b\u200c\u200d\ufeff"


def is_ascii(text: Column) -> Column:
    """Whether each character of a text is one byte: what concerns other letters need not be looked for."""
    return F.octet_length(text) == F.length(text)


def normalize(text: Column) -> Column:
    """Lower case, without marks on Latin letters; sharp s as ss; without soft hyphens and zero-width characters."""
    text = F.coalesce(text, F.lit(""))
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.replace(F.translate(F.lower(text), MARKED + _hidden, PLAIN), F.lit("ß"), F.lit("ss")))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, joined by - or _, in order."""
    return F.regexp_extract_all(normalize(text), F.lit(TOKEN_RUN), F.lit(0))


def normalize_sql(text: str) -> str:
    return f"replace(translate(translate(lower(coalesce({text}, '')), '{MARKED}', '{PLAIN}'), chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), 'ß', 'ss')"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({normalize_sql(text)}, '{TOKEN}')"


#: Endings of German nouns and adjectives and of English plurals: what is left, and what takes their place. The first that fits counts.
STEMS = ((r"^(.{2,}[^e])ies$", "y"), (r"^(.{4,}?)(?:ens|en|es|e)$", ""), (r"^(.{3,}e[lr])n$", ""), (r"^(.{3,}[^aiosu])s$", ""))


def stem(token: Column) -> Column:
    """A token without at most one inflection ending, if about four letters are left; derived words keep their ending."""
    left = [F.nullif(F.regexp_extract(token, ending, 1), F.lit("")) for ending, _ in STEMS]
    return F.coalesce(*(F.concat(x, F.lit(new)) for x, (_, new) in zip(left, STEMS, strict=True)), token)


def stem_sql(token: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({token}, '{ending}', 1), '') || '{new}'" for ending, new in STEMS) + f", {token})"


#: Verb stems after which German writes -et: after d and t, and after m and n behind another consonant (rechnet, not filmt).
TAKES_ET = "(?:[dt]|.[^aeiouylrhm]m|.[^aeiouylrhn]n|ch[mn])et$"


def verb_keys(key: Column) -> Column:
    """Stems of the verb that a stem in -t, -et or ge-...-t may be a form of; none for other stems."""
    n, et = F.length(key), key.endswith("et")
    bare = F.when(et & key.rlike(TAKES_ET), F.left(key, n - 2)).when(~et, F.left(key, n - 1))
    rest = F.substring(key, F.lit(3), n - F.when(et, 4).otherwise(3))
    found = F.array_compact(F.array(F.when(n >= 6, bare), F.when(key.startswith("ge") & (F.length(rest) >= 4), rest)))
    return F.when(key.rlike(r"^\p{L}+t$"), F.array_distinct(found))


def verb_keys_sql(key: str) -> str:
    bare = f"CASE WHEN length({key}) < 6 THEN NULL WHEN NOT ends_with({key}, 'et') THEN {key}[:-2] WHEN regexp_matches({key}, '{TAKES_ET}') THEN {key}[:-3] END"
    rest = f"nullif(regexp_extract({key}, CASE WHEN ends_with({key}, 'et') THEN '^ge(.{{4,}})et$' ELSE '^ge(.{{4,}})t$' END, 1), '')"
    return f"CASE WHEN regexp_matches({key}, '^\\p{{L}}+t$') THEN list_distinct([{bare}, {rest}]) END"


def fold_key(token: Column) -> Column:
    """One spelling for umlaut digraphs and hyphens."""
    for pair, one in (("ae", "a"), ("oe", "o"), ("ue", "u"), ("-", ""), ("_", "")):
        token = F.replace(token, F.lit(pair), F.lit(one))
    return token


def fold_sql(token: str) -> str:
    for pair, one in (("ae", "a"), ("oe", "o"), ("ue", "u"), ("-", ""), ("_", "")):
        token = f"replace({token}, '{pair}', '{one}')"
    return token
