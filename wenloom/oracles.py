"""SQL twins of the queries, for an engine other than Spark."""

from __future__ import annotations

_B = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]"
_F = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_LINES = rf"""
with stripped as (select line_id, regexp_replace(regexp_replace(coalesce(raw_line, ''), '^{_B}+', ''), '{_B}+$', '') as line from train_lines),
     lexed as (select *, regexp_full_match(line, '{_F}(?:\t{_F})*', 's') as quoting, regexp_full_match(line, '{_F}\t{_F}', 's') as columns from stripped),
     split as (select *, case when quoting and columns then regexp_extract(line, '^({_F})\t({_F})$', 1, 's') end as a,
                         case when quoting and columns then regexp_extract(line, '^({_F})\t({_F})$', 2, 's') end as b from lexed),
     fields as (select *, case when a[1] = '"' then replace(a[2:-2], '""', '"') else a end as text, case when b[1] = '"' then replace(b[2:-2], '""', '"') else b end as label from split),
     judged as (select *, case when not quoting then 'quoting' when not columns then 'columns'
                               when regexp_full_match(text, '{_B}*', 's') or not regexp_full_match(label, '{_B}*0*[0-9]{_B}*', 's') then 'value' end as reason from fields)
"""

_EMB = "emb as (select vec_id as row_id, label as y, embedding as x from embeddings)"
_FLAT = _EMB + ", flat as (select row_id, y, cast(unnest(x) as double) as value, generate_subscripts(x, 1) - 1 as idx from emb)"
_STRIPPED = "list_filter(tokens, lambda t: t is not null and trim(t) <> '')"
_TOKENS = f"tok as (select row_id, split_name, {_STRIPPED} as tokens, y from preprocessed_data)"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_DOCS = f"""{_TOKENS}, docs as (select row_id, coalesce(array_to_string(tokens, ' '), '') as text from tok where split_name = 'train'),
 gram as (select row_id, {_GRAMS} as grams from (select row_id, {_WORDS} as w from docs)),
 tf as (select row_id, term, count(*) as tf from (select row_id, unnest(grams) as term from gram) group by 1, 2),
 stat as (select term, count(*) as df, cast(sum(tf) as bigint) as total from tf group by 1),
 vocab as (select term, row_number() over (order by term) - 1 as idx, df, total from
           (select * from stat where df >= 2 and df <= 0.8 * (select count(*) from docs) order by total desc, term limit 8000)),
 idf as (select *, ln((1.0 + (select count(*) from docs)) / (1.0 + df)) + 1.0 as idf from vocab),
 raw as (select row_id, term, idx, tf * idf as v from tf join idf using (term)),
 weights as (select row_id, term, idx, v / sqrt(sum(v * v) over (partition by row_id)) as value from raw)"""


def _ranked(rows: str, groups: str, row_id: str = "row_id") -> str:
    part = f"partition by {groups} " if groups else ""
    return f"select *, row_number() over ({part}order by md5(concat_ws('-', cast({row_id} as varchar), '42')), {row_id}) as rank from {rows}"


_KFOLD = f"""n as (select count(*) as n from base), ranked as ({_ranked("base", "")}),
 folds as (select *, cast(case when rank - 1 < (n % 5) * (n // 5 + 1) then (rank - 1) // (n // 5 + 1)
           else n % 5 + (rank - 1 - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) end as int) as fold from ranked, n)"""
_CLEAN_URL = r"'https?://[a-z!$-_]+'"
_PRED = """pred as (select row_id, y, split, ordinal, model, p from (
   select row_id, label_id as y, case when row_id % 10 < 7 then 'train' when row_id % 10 < 9 then 'val' else 'test' end as split,
          unnest([0, 1]) as ordinal, unnest(['A', 'B']) as model, unnest([case when row_id % 5 = 0 then (label_id + 1) % 10 else label_id end, 3]) as p
   from train where label_id is not null))"""


def _metrics(by: str) -> str:
    """Per-class counts and averages of pred, grouped."""
    return f"""{_PRED}, both_ as (select {by}, unnest(list_distinct([y, p])) as label, y, p from pred),
 cls as (select {by}, label, count(*) filter (y = label and p = label) as tp, count(*) filter (y <> label and p = label) as fp,
                count(*) filter (y = label and p <> label) as fn, count(*) filter (y = label) as support from both_ group by {by}, label),
 prf as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall from cls),
 prf1 as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from prf),
 acc as (select {by}, avg(case when y = p then 1.0 else 0.0 end) as accuracy from pred group by {by}),
 avgs as (select {by}, avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1) as macro_f1, sum(precision * support) / sum(support) as weighted_precision,
                 sum(recall * support) / sum(support) as weighted_recall, sum(f1 * support) / sum(support) as weighted_f1,
                 sum(tp) / (sum(tp) + sum(fp)) as micro_precision, sum(tp) / (sum(tp) + sum(fn)) as micro_recall from prf1 group by {by}),
 avgs1 as (select *, case when micro_precision + micro_recall = 0 then 0.0 else 2 * micro_precision * micro_recall / (micro_precision + micro_recall) end as micro_f1 from avgs)"""


def _rd(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


_SIX = _rd("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "micro_f1")
_COMPARE = f"with {_metrics('ordinal, model')} select ordinal, model, {_SIX} from acc join avgs1 using (ordinal, model)"
_GRID = "grid as (select round(i * 0.1, 6) as w1, round(j * 0.1, 6) as w2, round((10 - i - j) * 0.1, 6) as w3 from range(11) a(i), range(11) b(j) where i + j <= 10)"


def _split_sql(stats: str, total: str, gain: str, allowed: str) -> str:
    return f"""with {_FLAT}, cell as (select idx, value, {stats} from flat group by 1, 2),
 run as (select *, {total} from cell window l as (partition by idx order by value rows unbounded preceding), t as (partition by idx)),
 gains as (select idx, value, round({gain}, 12) as gain from run where {allowed})"""


_BEST = " select idx, round(value, 8) + 0.0 as threshold, round(gain, 6) + 0.0 as gain from gains order by gains.gain desc, idx, value limit 1"
_GINI_COUNTS = ", ".join(f"count(*) filter (y = {k}) as c{k}" for k in range(10)) + ", count(*) as n"
_GINI_RUN = ", ".join(f"sum(c{k}) over l as l{k}, sum(c{k}) over t as t{k}" for k in range(10)) + ", sum(n) over l as ln, sum(n) over t as tn"


def _gini(side: str) -> str:
    n = {"l": "ln", "t": "tn", "r": "(tn - ln)"}[side]
    c = (lambda k: f"(t{k} - l{k})") if side == "r" else (lambda k: f"{side}{k}")
    return "(1.0 - " + " - ".join(f"pow({c(k)} / {n}, 2)" for k in range(10)) + ")"


_GH = "sum(0.1 - case when y = 0 then 1.0 else 0.0 end) as g, sum(cast(0.09 as double)) as h, count(*) as n"
_GH_RUN = "sum(g) over l as lg, sum(h) over l as lh, sum(g) over t as tg, sum(h) over t as th, sum(n) over l as ln, sum(n) over t as tn"
_GH_GAIN = "0.5 * (lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1))"
_Q = "(select avg(case when y = 0 then 1.0 else 0.0 end) from emb)"
_ROUND = f"sum({_Q} - case when y = 0 then 1.0 else 0.0 end) as g, sum({_Q} * (1 - {_Q})) as h, count(*) as n"
_GH_SPLIT = _split_sql(_GH, _GH_RUN, _GH_GAIN, "tn > ln and lh >= 1 and th - lh >= 1")

_NEAR = f"""{_FLAT}, tr as (select * from flat where row_id % 10 < 7), te as (select * from flat where row_id % 10 >= 7),
 norms as (select row_id, sqrt(sum(value * value)) + 1e-10 as n from flat group by 1),
 sims as (select te.row_id as query_id, tr.row_id, round(sum(te.value * tr.value) / any_value(a.n) / any_value(b.n), 12) as s from te join tr using (idx)
          join norms a on a.row_id = te.row_id join norms b on b.row_id = tr.row_id group by 1, 2),
 near as (select *, row_number() over (partition by query_id order by s desc, row_id) as rank from sims qualify rank <= 5)"""
_MNB = """least as (select min(value) as m from tr), cells as (select y, idx, sum(value - m + 1e-10) + 1.0 as s from tr, least group by 1, 2),
 logs as (select y, idx, ln(s) - ln(sum(s) over (partition by y)) as logp from cells),
 priors as (select y, ln(count(*) / sum(count(*)) over ()) as log_prior from (select distinct row_id, y from tr) group by 1)"""
_ALL = "corpus as (select row_id, text from train union all select row_id, text from dev union all select row_id, text from test)"
_IDS = f"""{_ALL}, chars as (select row_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as place from corpus where text is not null),
 vocab as (select c, 199 + row_number() over (order by c) as id from (select distinct c from chars where c <> '')),
 own as (select row_id, list(id order by place) as ids from chars join vocab using (c) group by 1),
 enc as (select row_id, list_concat([101], coalesce(ids, []), [102])[1:128] as ids from corpus left join own using (row_id))"""
_WORD_LIST = "['业内人士', '内存在', '专家业', '记者', '内存', '存在', '专家', '市民', '网友', '业内', '小时', '分钟', '年度', '票房']"
_SEGMENT = rf"""with recursive runs as (select row_id, unnest(regexp_extract_all(text, '\p{{Han}}+|[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\p{{Armenian}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}\p{{Lm}}\p{{N}}_ªº]+|[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{B}}\x{{1C}}-\x{{1F}}]')) as run,
   generate_subscripts(regexp_extract_all(text, '\p{{Han}}+|[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\p{{Armenian}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}\p{{Lm}}\p{{N}}_ªº]+|[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{B}}\x{{1C}}-\x{{1F}}]'), 1) as place from train),
 cut as (select row_id, place, 0 as step, '' as token, run as rest from runs
   union all select row_id, place, step + 1, token, substr(rest, len(token) + 1) from (
     select row_id, place, step, rest, case when not regexp_matches(rest, '^\p{{Han}}') then rest else coalesce(list_filter({_WORD_LIST}, lambda w: starts_with(rest, w))[1], rest[1]) end as token from cut where rest <> ''))
 select t.row_id, case when text is not null then coalesce(tokens, '') end as tokens from (select row_id, text from train) t left join (select row_id, string_agg(token, '|' order by place, step) as tokens from cut where step > 0 group by 1) using (row_id)"""


def oracle_sql() -> dict[str, str]:
    stop = "['本刊', '讯', '供稿', '版面', 'the', 'of']"
    return {
        "p2_found": _LINES + "select line_id, reason from judged where reason is not null",
        "p2_loaded": _LINES + f"select line_id, text, cast(regexp_replace(label, '{_B}', '', 'g') as int) as label_id from judged where reason is null",
        "load_labeled": rf"""with s as (select line_id, regexp_replace(regexp_replace(raw_line, '^{_B}+', ''), '{_B}+$', '') as line from train_lines where raw_line is not null),
            f as (select line_id, string_split(line, chr(9)) as p from s),
            k as (select line_id, p[1] as text, try_cast(regexp_replace(regexp_replace(p[2], '^{_B}+', ''), '{_B}+$', '') as bigint) as label_id, regexp_replace(regexp_replace(p[2], '^{_B}+', ''), '{_B}+$', '') as t from f where len(p) = 2)
            select line_id, text, name_cn as label from k join class_dim using (label_id) where selected and regexp_full_match(t, '[+-]?[0-9]+')""",
        "label_dim_join": "select row_id, label_id, name, name_cn from train join class_dim using (label_id)",
        "filter_selected_classes": "select row_id, name from train join class_dim using (label_id) where name in ('entertainment', 'finance', 'education', 'sports', 'science')",
        "three_splits": "select split, label_id, count(*) as n from (select label_id, 'train' as split from train union all select label_id, 'dev' from dev union all select label_id, 'test' from test) group by 1, 2",
        "class_distribution": "select label_id, count(*) as n from train group by 1",
        "label_encode": "select label, cast(row_number() over (order by label) - 1 as int) as idx from (select distinct y as label from preprocessed_data where y is not null)",
        "stratified_sample": f"with base as (select row_id, label_id from train where label_id is not null) select row_id, label_id from ({_ranked('base', 'label_id')}) where rank <= 200",
        "bootstrap_sample": f"""with base as (select vec_id as row_id from embeddings), ranked as ({_ranked("base", "")}), n as (select count(*) as n from base),
            draws as (select tree, (cast('0x' || md5(concat_ws('-', tree, rank - 1, '42'))[1:8] as bigint) % n) + 1 as pick from ranked, n, range(3) t(tree))
            select cast(tree as int) as tree, row_id, count(*) as times from draws join ranked on pick = rank group by 1, 2""",
        "row_subsample": """with base as (select cast(grp as int) as grp, vec_id as row_id, concat_ws('-', grp, vec_id) as k from embeddings, range(3) t(grp)),
            ranked as (select *, row_number() over (partition by grp order by md5(concat_ws('-', k, '42')), k) as rank from base)
            select grp, row_id from ranked where rank <= floor((select count(*) from embeddings) * 0.5)""",
        "kfold_assign": f"with base as (select row_id from train), {_KFOLD} select row_id, fold from folds",
        "split_assign": "select case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'val' else 'test' end as split, count(*) as n from documents group by 1",
        "clean_text": rf"""with a as (select doc_id, regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), {_CLEAN_URL}, '', 'g') as t from documents),
            b as (select doc_id, regexp_replace(t, '(^|[^\p{{L}}\p{{M}}\p{{N}}_.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}', '\1', 'g') as t from a)
            select doc_id, trim(regexp_replace(t, '{_B}+', ' ', 'g')) as clean from b""",
        "strip_url": f"select row_id, regexp_replace(text, {_CLEAN_URL}, '', 'g') as clean from train",
        "tokenize": f"select row_id, array_to_string({_WORDS}, '|') as tokens from train",
        "stopword_filter": f"with {_TOKENS} select row_id, array_to_string(list_filter(tokens, lambda t: not list_contains({stop}, t)), '|') as tokens from tok",
        "stopword_antijoin": f"with {_TOKENS}, u as (select row_id, unnest(tokens) as token from tok) select row_id, token, count(*) as n from u where not list_contains({stop}, token) group by 1, 2",
        "token_stats": f"with {_TOKENS} select split_name, count(*) as n, round(avg(len(tokens)), 6) + 0.0 as mean_tokens from tok where tokens is not null group by 1",
        "ngrams_1_2": f"select row_id, case when w is not null then array_to_string({_GRAMS}, '|') end as grams from (select row_id, {_WORDS} as w from train)",
        "term_df": f"with {_DOCS} select * from stat",
        "tfidf_vocab": f"with {_DOCS} select term, cast(idx as int) as idx, df, total from vocab",
        "idf": f"with {_DOCS} select term, round(idf, 6) + 0.0 as idf from idf",
        "tfidf": f"with {_DOCS} select row_id, term, cast(idx as int) as idx, round(value, 6) + 0.0 as value from weights",
        "tfidf_top_terms": f"""with {_DOCS}, s as (select y, term, sum(value) as weight from weights join (select row_id, y from tok where split_name = 'train' and y is not null) using (row_id) group by 1, 2)
            select y, cast(row_number() over (partition by y order by round(weight, 6) desc, term) as int) as rank, term, round(weight, 4) + 0.0 as weight from s qualify rank <= 5""",
        "w2v_weighted_pool": f"""with {_TOKENS}, docs as (select row_id, coalesce(array_to_string(tokens, ' '), '') as text from tok where split_name = 'train'),
            c as (select row_id, term, count(*) as tf from (select row_id, unnest(tokens) as term from tok where split_name = 'train') group by 1, 2),
            u as (select row_id, term, count(*) as tf from (select row_id, unnest({_WORDS}) as term from docs) group by 1, 2),
            s as (select term, count(*) as df, sum(tf) as total from u group by 1),
            v as (select term, ln((1.0 + (select count(*) from docs)) / (1.0 + df)) + 1.0 as idf from (select * from s where df >= 2 and df <= 0.8 * (select count(*) from docs) order by total desc, term limit 8000)),
            k as (select term, cast(i as int) as idx, cast('0x' || md5(term)[1 + 4 * i : 4 + 4 * i] as bigint) / 65535 as x from (select term from c group by 1 having sum(tf) >= 5), range(4) r(i))
            select row_id, idx, round(sum(tf * coalesce(idf, 1.0) * x) / sum(tf * coalesce(idf, 1.0)), 6) + 0.0 as value from c join k using (term) left join v using (term) group by 1, 2""",
        "char_encode": f"with {_IDS} select row_id, array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda i: 0)), ',') as ids from enc",
        "bert_encode": f"with {_IDS} select row_id, array_to_string(list_transform(range(128), lambda i: case when i < len(ids) then 1 else 0 end), ',') as mask, 128 as length from enc",
        "zscore_fit": f"with {_FLAT} select cast(idx as int) as idx, round(avg(value), 6) + 0.0 as mean, round(stddev_pop(value), 6) + 0.0 as std from flat group by 1",
        "zscore_lineitem": "select cast(idx as int) as idx, round(avg(value), 4) + 0.0 as mean, round(stddev_pop(value), 4) + 0.0 as std from (select unnest([0, 1, 2, 3]) as idx, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from lineitem) group by 1",
        "zscore_transform": f"with {_FLAT}, s as (select idx, avg(value) as m, stddev_pop(value) as d from flat group by 1) select row_id, cast(idx as int) as idx, round((value - m) / d, 6) + 0.0 as value from flat join s using (idx)",
        "minmax_transform": f"with {_FLAT}, s as (select idx, min(value) as m, max(value) - min(value) as d from flat group by 1) select row_id, cast(idx as int) as idx, round((value - m) / d, 6) + 0.0 as value from flat join s using (idx)",
        "weighted_fusion": f"with {_FLAT} select a.row_id, cast(a.idx as int) as idx, round(0.2 * a.value + 0.3 * b.value + 0.5 * (2.0 * a.value), 6) + 0.0 as value from flat a join flat b on a.row_id = b.row_id and b.idx = 63 - a.idx",
        "feature_family_join": """select row_id, split_name, y, len(x_pca) as bert, len(x_w2v) as word2vec, len(x_fused) as fused from (select row_id, x_pca from bert_features_pca_100d)
            join (select row_id, x_w2v from word2vec_features) using (row_id) join (select row_id, x_fused from fused_features) using (row_id) join (select row_id, split_name, y from preprocessed_data) using (row_id)""",
        "weight_grid": f"with {_GRID} select * from grid",
        "top_weights": f"with {_GRID} select w1, w2, w3, round(w1 * 0.5 + w2 * w3, 6) + 0.0 as f1_macro from grid order by 4 desc, 1, 2, 3 limit 10",
        "covariance": f"with {_FLAT} select cast(a.idx as int) as i, cast(b.idx as int) as j, round(covar_samp(a.value, b.value), 8) + 0.0 as cov from flat a join flat b on a.row_id = b.row_id and a.idx <= b.idx group by 1, 2",
        "cumulative_variance": f"""with {_FLAT}, v as (select idx, var_pop(value) as v from flat group by 1), c as (select idx, round(sum(v) over (order by idx) / sum(v) over (), 9) as c from v)
            select cast(idx as int) as idx, round(c, 6) + 0.0 as cumulative, idx = (select min(idx) from c where c.c >= 0.95) as enough from c""",
        "reconstruction_mse": f"with {_FLAT} select cast(idx as int) as idx, round(avg(pow(value - floor(value * 100) / 100, 2)), 9) + 0.0 as mse from flat group by 1",
        "cosine_similarity": f"""with {_FLAT}, n as (select row_id, sqrt(sum(value * value)) + 1e-10 as n from flat group by 1)
            select a.row_id, round(sum(a.value * b.value) / (any_value(x.n) * any_value(y.n)), 6) + 0.0 as cosine from flat a join flat b on b.row_id = a.row_id + 1 and a.idx = b.idx
            join n x on x.row_id = a.row_id join n y on y.row_id = b.row_id group by 1""",
        "knn_cosine_topk": f"with {_NEAR} select query_id, row_id, cast(rank as int) as rank, round(s, 6) + 0.0 as similarity from near",
        "knn_predict": f"with {_NEAR} select query_id, label as p from (select query_id, e.label, count(*) as n from near join embeddings e on e.vec_id = near.row_id group by 1, 2) qualify row_number() over (partition by query_id order by n desc, label) = 1",
        "softmax": f"with {_FLAT}, t as (select row_id, max(value) as m from flat group by 1), e as (select row_id, idx, exp(value - m) as e from flat join t using (row_id)) select row_id, cast(idx as int) as idx, round(e / sum(e) over (partition by row_id), 6) + 0.0 as value from e",
        "gelu": f"with {_FLAT} select row_id, cast(idx as int) as idx, round(0.5 * value * (1 + tanh(sqrt(2 / pi()) * (value + 0.044715 * value * value * value))), 6) + 0.0 as value from flat",
        "layer_norm": f"with {_FLAT}, s as (select row_id, avg(value) as m, var_pop(value) as v from flat group by 1) select row_id, cast(idx as int) as idx, round((value - m) / sqrt(v + 1e-12), 6) + 0.0 as value from flat join s using (row_id)",
        "diff_stats": f"""with {_FLAT}, p as (select a.idx, a.value as a, b.value as b from flat a join flat b on a.row_id = b.row_id and b.idx = 63 - a.idx)
            select cast(idx as int) as idx, round(max(abs(a - b)), 6) + 0.0 as max_diff, round(avg(abs(a - b)), 6) + 0.0 as mean_diff, round(median(abs(a - b)), 6) + 0.0 as median_diff, round(corr(a, b), 6) + 0.0 as corr,
                   round(min(a), 6) + 0.0 as low, round(max(a), 6) + 0.0 as high, round(stddev_pop(a), 6) + 0.0 as std from p group by 1""",
        "gini_impurity": "select source, round(1 - sum(n * n) / (sum(n) * sum(n)), 6) + 0.0 as gini from (select source, label_id, count(*) as n from train where label_id is not null group by 1, 2) group by 1",
        "mse_impurity": "select l_returnflag, round(var_pop(l_quantity), 4) + 0.0 as mse, round(avg(l_quantity), 4) + 0.0 as leaf from lineitem group by 1",
        "majority_label": "select source, label_id from (select source, label_id, count(*) as n from train where label_id is not null group by 1, 2) qualify row_number() over (partition by source order by n desc, label_id) = 1",
        "best_split_gini": _split_sql(_GINI_COUNTS, _GINI_RUN, f"{_gini('t')} - ln / tn * {_gini('l')} - (tn - ln) / tn * {_gini('r')}", "tn > ln") + _BEST,
        "best_split_mse": _split_sql(
            "count(*) as n, sum(cast(y as double)) as s, sum(cast(y as double) * y) as q",
            "sum(n) over l as ln, sum(s) over l as ls, sum(q) over l as lq, sum(n) over t as tn, sum(s) over t as ts, sum(q) over t as tq",
            "(tq / tn - pow(ts / tn, 2)) - ln / tn * (lq / ln - pow(ls / ln, 2)) - (tn - ln) / tn * ((tq - lq) / (tn - ln) - pow((ts - ls) / (tn - ln), 2))",
            "tn > ln",
        )
        + _BEST,
        "best_split_xgb": _GH_SPLIT + _BEST,
        "xgb_split_gain": _GH_SPLIT + " select cast(idx as int) as idx, round(max(gain), 6) + 0.0 as gain from gains group by 1",
        "xgb_leaf_weight": "select label as y, round(-sum(0.1 - case when label = 0 then 1.0 else 0.0 end) / (sum(0.09) + 1), 6) + 0.0 as weight from embeddings group by 1",
        "tree_root_split": _split_sql(_GINI_COUNTS, _GINI_RUN, f"{_gini('t')} - ln / tn * {_gini('l')} - (tn - ln) / tn * {_gini('r')}", "tn > ln") + " select cast(idx as int) as idx, round(value, 8) + 0.0 as threshold from gains order by gains.gain desc, gains.idx, value limit 1",
        "xgb_root_split": _split_sql(_ROUND, _GH_RUN, _GH_GAIN, "tn > ln and lh >= 1 and th - lh >= 1") + " select cast(idx as int) as idx, round(value, 8) + 0.0 as threshold from gains order by gains.gain desc, gains.idx, value limit 1",
        "lr_first_step": f"""with {_FLAT}, long as (select row_id, y, idx, value from flat union all select row_id, y, 64, 1.0 from emb), n as (select count(*) as n from emb)
            select cast(c as int) as y, cast(idx as int) as idx, round(-sum(value * (0.1 - case when long.y = c then 1.0 else 0.0 end)) / any_value(n), 6) + 0.0 as weight from long, n, range(10) k(c) group by 1, 2""",
        "pca_properties": f"with {_FLAT} select 'orthonormal' as property, 0.0 as value union all select 'reconstruction', 0.0 union all select 'variance', round(sum(v), 5) + 0.0 from (select var_samp(value) as v from flat group by idx)",
        "segment": _SEGMENT,
        "tree_predict": "select vec_id as row_id, case when embedding[1]::double <= 0.0 then case when embedding[2]::double <= 0.05 then 1 else 2 end else 3 end as p from embeddings",
        "boost_init": "select y, round(ln(count(*) / (select count(*) from preprocessed_data where y is not null) + 1e-10), 6) + 0.0 as f0 from preprocessed_data where y is not null group by 1",
        "mnb_fit": f"with {_FLAT}, tr as (select * from flat), {_MNB} select y, cast(idx as int) as idx, round(logp, 6) + 0.0 as logp, round(log_prior, 6) + 0.0 as log_prior from logs join priors using (y)",
        "mnb_predict": f"""with {_FLAT}, tr as (select * from flat where row_id % 10 < 7), {_MNB},
            s as (select f.row_id, l.y, any_value(log_prior) + sum((value - m + 1e-10) * logp) as s from flat f join logs l using (idx) join priors p on p.y = l.y, least where f.row_id % 10 >= 7 group by 1, 2)
            select row_id, y as p from s qualify row_number() over (partition by row_id order by round(s, 10) desc, y) = 1""",
        "softmax_lr_step": f"""with {_FLAT}, long as (select row_id, y, idx, value from flat union all select row_id, y, 64, 1.0 from emb), n as (select count(*) as n from emb)
            select cast(c as int) as y, cast(idx as int) as idx, round(sum(value * (0.1 - case when long.y = c then 1.0 else 0.0 end)) / any_value(n), 6) + 0.0 as gradient from long, n, range(10) k(c) group by 1, 2""",
        "feature_subset": "select cast(tree as int) as tree, cast(idx as int) as idx from range(5) t(tree), range((select max(len(embedding)) from embeddings)) r(idx) qualify row_number() over (partition by tree order by md5(concat_ws('-', tree, idx, '42'))) <= floor(sqrt((select max(len(embedding)) from embeddings)))",
        "ovo_pairs": "select a.name, b.name as other from class_dim a join class_dim b on a.name < b.name where a.selected and b.selected",
        "hard_vote": """with v as (select vec_id as row_id, unnest([embedding[1], embedding[2], embedding[3]])::double as x from embeddings), p as (select row_id, cast(cast(floor(x * 20) as bigint) % 3 + 3 as int) as p from v)
            select row_id, p from (select row_id, p, count(*) as n from p group by 1, 2) qualify row_number() over (partition by row_id order by n desc, p) = 1""",
        "ovo_vote": """with m as (select vec_id as row_id, embedding[1]::double as a, embedding[2]::double + 0.01 as b, embedding[3]::double - 0.01 as c from embeddings),
            v as (select row_id, unnest([0, 1, 2]) as p, unnest([(a > 0)::int + (b > 0)::int, (a < 0)::int + (c > 0)::int, (b < 0)::int + (c < 0)::int]) as n from m)
            select row_id, p from v qualify row_number() over (partition by row_id order by n desc, p) = 1""",
        "label_universe": f"with {_PRED} select y as label from pred where model = 'A' union select p from pred where model = 'A'",
        "confusion_matrix": f"""with {_PRED}, a as (select y, p from pred where model = 'A'), l as (select y as label from a union select p from a)
            select i.label as y, j.label as p, count(a.y) as n from l i cross join l j left join a on a.y = i.label and a.p = j.label group by 1, 2""",
        "per_class_prf": f"with {_metrics('model')} select label, tp, fp, fn, support, {_rd('precision', 'recall', 'f1')} from prf1 where model = 'A'",
        "prf_averages": f"""with {_metrics('model')}, a as (select * from avgs1 where model = 'A')
            select average, {_rd("precision", "recall", "f1")} from (select 'macro' as average, macro_precision as precision, macro_recall as recall, macro_f1 as f1 from a
            union all select 'macro_of_means', macro_precision, macro_recall, 2 * macro_precision * macro_recall / (macro_precision + macro_recall) from a
            union all select 'weighted', weighted_precision, weighted_recall, weighted_f1 from a union all select 'micro', micro_precision, micro_recall, micro_f1 from a)""",
        "accuracy": f"with {_PRED} select model, round(avg(case when y = p then 1.0 else 0.0 end), 6) + 0.0 as accuracy from pred group by 1",
        "classification_report": f"""with {_metrics('model')}, n as (select sum(support)::bigint as support from prf1 where model = 'A')
            select ordinal, label, {_rd("precision", "recall", "f1")}, support from (
            select 0 as ordinal, cast(label as varchar) as label, precision, recall, f1, support from prf1 where model = 'A'
            union all select 1, 'accuracy', null, null, accuracy, support from acc, n where model = 'A'
            union all select 2, 'macro avg', macro_precision, macro_recall, macro_f1, support from avgs1, n where model = 'A'
            union all select 3, 'weighted avg', weighted_precision, weighted_recall, weighted_f1, support from avgs1, n where model = 'A')""",
        "model_metrics": f"select accuracy, macro_precision, macro_recall, macro_f1, weighted_f1, micro_f1 from ({_COMPARE}) where model = 'A'",
        "split_metrics": f"with {_metrics('model, split')} select split, {_rd('accuracy', 'macro_f1', 'weighted_f1')} from acc join avgs1 using (model, split) where model = 'A'",
        "comparison_table": _COMPARE,
        "best_model": f"select model, macro_f1 from ({_COMPARE}) order by macro_f1 desc, ordinal limit 1",
        "vote_weights": f"select model, round(macro_f1 / sum(macro_f1) over (), 6) + 0.0 as weight from ({_COMPARE})",
        "soft_vote": f"""with {_FLAT}, s as (select row_id, idx // 3 as m, idx % 3 as label, value from flat where idx < 9), t as (select row_id, m, max(value) as top from s group by 1, 2),
            e as (select row_id, m, label, exp(value - top) as e from s join t using (row_id, m)), q as (select row_id, m, label, e / sum(e) over (partition by row_id, m) as q from e)
            select row_id, cast(label as int) as label, round(sum(q * case m when 0 then 0.45 when 1 then 0.3 else 0.25 end), 6) + 0.0 as q from q group by 1, 2""",
        "cv_summary": f"with {_PRED}, base as (select row_id, y, p from pred where model = 'A'), {_KFOLD}, a as (select fold, avg(case when y = p then 1.0 else 0.0 end) as a from folds group by 1) select round(avg(a), 6) + 0.0 as mean, round(stddev_pop(a), 6) + 0.0 as std from a",
    }
