"""The queries of the training-data problems, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wenloom.llm import bpe, copies, forms, leaks, looks, overlap, quota, similar, subjects, terms
from wenloom.sources.tables import cut, spread, table


def _evals(spark: SparkSession, folder: str) -> DataFrame:
    dev, test = (table(spark, folder, n).select("row_id", "text", "source").withColumn("split_name", F.lit(n)) for n in ("dev", "test"))
    return dev.unionByName(test)


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    train = cut(overlap.canonical(spread(table(spark, folder, "train").select("row_id", "text"), 1)))
    return overlap.overlaps(train, cut(overlap.canonical(_evals(spark, folder))))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).select("train_row_id", "eval_row_id")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.report(_overlaps(spark, folder), _evals(spark, folder))


def _quota(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct records, their counts by bucket, and the report; the tree is root, selected or not, class."""
    distinct = quota.records(table(spark, folder, "train"))
    tree = table(spark, folder, "class_dim").select("label_id", F.array(F.when(F.col("selected"), "selected").otherwise("other")).alias("path"))
    count = cut(quota.counts(distinct))
    return distinct, count, quota.plan_report(table(spark, folder, "sample_plans"), count, tree)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _quota(spark, folder)[2].where("short > 0").select("plan_id", "label_id")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return _quota(spark, folder)[2]


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quota.draw(*_quota(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    one = (("bert", "bert_features_pca_100d", "x_pca"), ("word2vec", "word2vec_features", "x_w2v"), ("fused", "fused_features", "x_fused"))
    bert, word2vec, fused = (similar.prepared(table(spark, folder, name), family, "row_id", column) for family, name, column in one)
    return bert.unionByName(word2vec).unionByName(fused)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar.alike(_vectors(spark, folder), 0.9).select("family", "low_row_id", "high_row_id").distinct()


def p4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return similar.nearest(_vectors(spark, folder), 10)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    records = cut(copies.canonical(spread(table(spark, folder, "train").select("row_id", "text"), 1)))
    return copies.members(records, copies.collapse(records))


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    records = copies.canonical(spread(table(spark, folder, "train").select("row_id", "text"), 1))
    return copies.collapse(records).select("first_row_id", "leaves", "copies")


def _train_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "preprocessed_data").where("split_name = 'train'").select("row_id", "tokens")


def p6_terms(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _train_tokens(spark, folder)
    return terms.marked(terms.frequencies(tokens), tokens)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_terms(spark, folder).where("mark is not null").select("term", "mark")


def p7_forms(spark: SparkSession, folder: str) -> DataFrame:
    return forms.forms(spread(table(spark, folder, "train").select("row_id", "text"), 1)).select("row_id", "form")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return forms.lookalikes(cut(forms.forms(spread(table(spark, folder, "train").select("row_id", "text"), 1))))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(spread(table(spark, folder, "documents").select("doc_id", "text"), 1))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), 1)
    return leaks.leaked(leaks.passages(docs, table(spark, folder, "heldout_items")))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), 1)
    headlines = spread(table(spark, folder, "train").select("text", "label_id"), 1)
    return subjects.subjects(cut(subjects.on_classes(*subjects.model(headlines, docs, table(spark, folder, "doc_labels")))))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder)


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(_subjects(spark, folder), table(spark, folder, "documents").select("doc_id"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_DISTINCT = "select label_id, count(distinct headline_key) as available from train where label_id is not null and headline_key is not null group by 1"
_NEEDED = "greatest(coalesce(min_rows, 0), coalesce(cast(round(cast(target_share as decimal(20, 12)) * sample_rows) as bigint), 0))"
_TERMS = r"""
with rows as (select row_id, tokens from preprocessed_data where split_name = 'train'),
     total as (select count(distinct row_id) as n from rows where tokens is not null),
     pairs as (select row_id, unnest(tokens) as term from rows),
     counted as (select term, count(*) as occurrences, count(distinct row_id) as records from pairs
                 where term is not null and row_id is not null and not regexp_full_match(term, '[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{202F}]*') group by 1)
select term, occurrences, records, case when records < 2 then 'rare' when records > 0.8 * n then 'common' end as mark from counted, total
"""




def _looks_sql() -> str:
    """Table ``looked``: row_id, text and skeleton of the rows with a letter or digit."""
    ranges = (*range(0x2E80, 0x2FE0), *range(0xF900, 0xFB00), *range(0xFF01, 0xFFEF))
    single = {chr(i): f for i in ranges if isinstance(f := looks._plain_form(i), str) and len(f) == 1} | looks.LOOKS_LIKE
    pair = f"'{''.join(single)}', '{''.join(single.values()).replace(chr(39), chr(39) * 2)}'"
    gone = r"[\p{Cf}\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{FE00}-\x{FE0F}" + looks.UNSEEN + "]"
    seen = rf"regexp_replace(regexp_replace(text, '{gone}', '', 'g'), '\p{{Zs}}', ' ', 'g')"
    skeleton = f"nfc_normalize(translate(nfc_normalize(translate({seen}, {pair})), {pair}))"
    return rf"looked as (select * from (select row_id, text, {skeleton} as skeleton from train) where regexp_matches(skeleton, '[\p{{L}}\p{{N}}]'))"


def _copies_sql() -> str:
    bars = f"translate(skeleton, '{looks.BARS}', '{'|' * len(looks.BARS)}')"
    bare = rf"lower(regexp_replace({bars}, '[\p{{P}}\p{{Z}}\t\n\r\x{{B}}\x{{C}}\x{{85}}]', '', 'g'))"
    return f"""with {_looks_sql()}, keyed as (select row_id, array_to_string(list_sort(list_filter(string_split({bare}, '|'), lambda p: p <> '')), '|') as k from looked),
        firsts as (select *, min(row_id) over (partition by k) as first_row_id from keyed) select first_row_id, row_id from firsts where row_id <> first_row_id"""


def _alike_sql() -> str:
    return f"""with {_looks_sql()}, firsts as (select row_id, text, skeleton, min(row_id) over (partition by skeleton) as first_row_id from looked)
        select a.first_row_id, a.row_id from firsts a join looked b on b.row_id = a.first_row_id where a.text <> b.text"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _copies_sql(),
        "p7_found": _alike_sql(),
        "p3_found": f"select plan_id, p.label_id from sample_plans p left join ({_DISTINCT}) d on d.label_id = p.label_id where coalesce(available, 0) < {_NEEDED}",
        "p6_terms": _TERMS,
        "p6_found": f"select term, mark from ({_TERMS}) where mark is not null",
    }
