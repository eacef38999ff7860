"""One consistent form for look-alike text (problem 7): script-aware repair.

Every text first gets its plain form (``looks.plain``). Tokens are runs of
alphabetic letters; the corpus vocabulary holds how often each is written. Then
two stages give each token with look-alike letters its spelling:

1. Repair: a token of several scripts gets the letters of one script, if the
   corpus vocabulary has a token of one script with the same skeleton: the one
   without look-alikes, else the most frequent.
2. Unification: what still looks equal but is written differently gets one
   spelling: tokens in one script that look like another known token take that
   one's letters, and mixed tokens that no vocabulary entry explains take their
   dominant script's, once two records share the look.

Stage 1 alone would leave whole words of another script apart from the words
they look like; with stage 2 texts with equal looks have equal forms. Words of
another script that look like no other word keep their letters.

Defined cases: null gives null, empty gives empty; rows keep their ids, also
repeated ones; of an id that repeats the smallest text counts as the first; an
empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wenloom.llm import looks
from wenloom.sources.tables import cut

_TOKEN = regex.compile(r"(?V1)[[\p{L}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+")
_SCRIPTS = {"latin": regex.compile(r"\p{Latin}"), "cyrillic": regex.compile(r"\p{Cyrillic}"), "greek": regex.compile(r"\p{Greek}"), "armenian": regex.compile(r"\p{Armenian}")}
_ODD = frozenset(looks.LOOKS_LIKE)
_LETTER = regex.compile(r"(?V1)[\p{L}--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]")
_WORD = regex.compile(r"[\p{L}\p{N}]")


def scripts(token: str) -> dict[str, int]:
    """How many letters each script has in the token."""
    return {k: n for k, r in _SCRIPTS.items() if (n := len(r.findall(token)))}


def dominant(skeleton: str) -> str:
    """The token's spelling in its dominant script, told from its skeleton alone."""
    own = scripts(skeleton)
    if not own or max(own, key=lambda k: (own[k], k)) == "latin":
        return skeleton
    script = _SCRIPTS[max(own, key=lambda k: (own[k], k))]
    twin = {b: a for a, b in reversed(looks.LOOKS_LIKE.items()) if script.match(a)}
    return "".join(twin.get(c, c) for c in skeleton)


_READ = T.StructType().add("form", "string").add("word", "boolean").add("odd", "boolean").add(
    "tokens", T.ArrayType(T.StructType().add("token", "string").add("skeleton", "string").add("odd", "boolean").add("mixed", "boolean"))
)


@F.pandas_udf(_READ)
def _read(text: pd.Series) -> pd.DataFrame:
    plain = text.map(looks.plain)
    tokens, odd = [], []
    for t in plain:
        if t is None or not _LETTER.search(t):
            tokens.append([])
            odd.append(False)
            continue
        own = []
        for w in sorted(set(_TOKEN.findall(t))):
            o = not _ODD.isdisjoint(w)
            own.append({"token": w, "skeleton": looks.skeleton(w) if o else w, "odd": o, "mixed": o and len(scripts(w)) > 1})
        tokens.append(own)
        odd.append(any(x["odd"] for x in own))
    return pd.DataFrame({"form": plain, "word": plain.map(lambda t: t is not None and _WORD.search(t) is not None), "odd": odd, "tokens": tokens})


def vocabulary(read: DataFrame) -> DataFrame:
    """``skeleton, token, odd, mixed, n``: the spellings of every skeleton that an odd token has, and in how many records."""
    seen = read.select(F.explode("tokens").alias("t")).select("t.*")
    wanted = read.where("odd").select(F.explode(F.filter("tokens", lambda t: t["odd"])["skeleton"]).alias("skeleton")).distinct()
    return seen.groupBy("skeleton", "token", "odd", "mixed").agg(F.count(F.lit(1)).alias("n")).join(wanted, "skeleton", "left_semi")


def spellings(known: DataFrame) -> DataFrame:
    """``token, spelling, stage``: what each odd token becomes, and by which stage; tokens that stay are left out."""
    best = known.groupBy("skeleton").agg(
        F.min(F.when(~F.col("mixed"), F.struct("odd", (-F.col("n")).alias("m"), "token")))["token"].alias("known"),
        F.sum("n").alias("shared"),
    )
    odd = known.where("odd").select("skeleton", "token", "mixed").join(best, "skeleton")
    spelling = F.coalesce("known", F.when(F.col("shared") > 1, _dominant(F.col("skeleton"))), "token")
    stage = F.when(F.col("mixed") & F.col("known").isNotNull(), "repair").otherwise("unification")
    return odd.select("token", spelling.alias("spelling"), stage.alias("stage")).where("token <> spelling")


@F.pandas_udf(T.StringType())
def _dominant(skeleton: pd.Series) -> pd.Series:
    return skeleton.map(dominant)


@F.pandas_udf(T.StringType())
def _replace(form: pd.Series, names: pd.Series) -> pd.Series:
    def one(text: str, pairs: list) -> str:
        new = {p["token"]: p["spelling"] for p in pairs}
        return _TOKEN.sub(lambda m: new.get(m[0], m[0]), text)

    return pd.Series([one(t, p) for t, p in zip(form, names, strict=True)], dtype=object)


def forms(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """``row_id, text, form, word``: the one form of every text; word: it has a letter or digit.

    Every text is read once; only texts with odd tokens, and the vocabulary, are shuffled.
    """
    read = cut(df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), _read(F.col(text)).alias("r")).select("row_id", "text", "r.*"))
    plain = read.where("not odd").select("row_id", "text", "form", "word")
    odd = read.where("odd").select("row_id", "text", "form", "word", F.filter("tokens", lambda t: t["odd"])["token"].alias("tokens"))
    texts = odd.select("text", "form", F.explode("tokens").alias("token")).distinct()
    names = texts.join(spellings(vocabulary(read)), "token").groupBy("text", "form").agg(F.collect_list(F.struct("token", "spelling")).alias("names"))
    mended = names.select("text", _replace(F.col("form"), F.col("names")).alias("mended"))
    return plain.unionByName(odd.join(mended, "text", "left").select("row_id", "text", F.coalesce("mended", "form").alias("form"), "word"))


def lookalikes(formed: DataFrame) -> DataFrame:
    """``first_row_id, row_id`` of rows that look like an earlier row but differ in characters.

    Rows of one form with different texts include one whose text isn't the form
    itself; only forms of such rows are joined back.
    """
    rows = formed.where("word").select("row_id", "text", "form")
    heads = rows.groupBy("form").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("text") != F.col("form")).alias("differs"))
    alike = rows.join(heads.where("differs and n > 1").select("form", "first_row_id"), "form")
    first = alike.where("row_id = first_row_id").groupBy("form").agg(F.min("text").alias("first_text"))
    return alike.join(first, "form").where("text <> first_text").select("first_row_id", "row_id")
