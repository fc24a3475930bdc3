"""One registered query for each operator of this package, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import collocations, complement_packing, hard_negatives, jaccard_join, language_model, licences, near_vectors, packing, quality, sentence_pieces, suffix_dedup, topk_search, toxicity
from tarmac.llm.common import crc_fold
from tarmac.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(configure(spark), folder)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return run

    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; callers of the operators pass any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _decided(scores: DataFrame, folds: int, held: int) -> DataFrame:
    return scores.withColumn("held_out", crc_fold("doc_id", folds) == held).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def _plain_sql(text: str) -> str:
    """A text's canonical form for licences, in SQL alone: spellings, then copyright lines, then gaps."""
    said = f"""replace(replace(replace(replace(replace(replace(replace(lower({text}),
      'licence', 'license'), 'sub-license', 'sublicense'), 'organisation', 'organization'), 'favour', 'favor'), 'honour', 'honor'),
      'fulfil ', 'fulfill '), 'acknowledgement', 'acknowledgment')"""
    said = f"""replace(replace(replace(replace(replace(replace({said}, 'merchantibility', 'merchantability'),
      'noninfringement', 'non-infringement'), 'copyright holder', 'copyright owner'), 'https://', 'http://'), 'per cent', 'percent'), '&', ' and ')"""
    holder = (
        "(?m)^[^\\p{L}\\p{N}\\n]*(copyright[^\\p{L}\\p{N}\\n]*(\\(c\\)|©|[0-9]{4}|[\\[<{]|by )[^\\n]*|copyright[^\\n]*[^0-9][12][0-9]{3}[^\\n]*"
        "|©[^\\n]*|\\(c\\)[^\\p{L}\\p{N}\\n]*([0-9]{4}|copyright)[^\\n]*|all rights reserved[^\\p{L}\\p{N}\\n]*)$"
    )
    return f"trim(regexp_replace(regexp_replace({said}, '{holder}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_COMPONENTS = """
  , reach as (select a as id, b as root from {edges} union select a, a from {edges}
    union select r.id, e.b from reach r join {edges} e on e.a = r.root)"""


@query(
    """with recursive v as (select vec_id, embedding::double[] as e from embeddings
      where embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
    u as (select vec_id, e from v where list_inner_product(e, e) > 0),
    links as (select p.vec_id as a, q.vec_id as b from u p join u q on p.vec_id <> q.vec_id and list_cosine_similarity(p.e, q.e) >= 0.9)"""
    + _COMPONENTS.format(edges="links")
    + """
    select t.vec_id, (select count(*) from links where a = t.vec_id) as n_links,
      least(t.vec_id, coalesce((select min(root) from reach where id = t.vec_id), t.vec_id)) as component_id,
      t.vec_id = least(t.vec_id, coalesce((select min(root) from reach where id = t.vec_id), t.vec_id)) as kept
    from embeddings t"""
)
def op1_near_vectors(spark, folder):
    return near_vectors.near_duplicates(read(spark, folder, "embeddings"), 0.9)


@query()
def op2_quality(spark, folder):
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    scores = quality.score(docs, quality.train(docs, labels, "quality", 5, [0]))
    return _decided(scores, 5, 0).select("doc_id", "held_out", "score", "predicted")


@query()
def op3_toxicity(spark, folder):
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    scores = toxicity.score(docs, toxicity.train(docs, labels, "toxic", 4, [2]))
    return _decided(scores, 4, 2).select("doc_id", "held_out", "score", "predicted", "evidence")


@query()
def op4_packing(spark, folder):
    pieces = packing.pack(read(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"), 4096, 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op5_sentence_pieces(spark, folder):
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = sentence_pieces.encode(read(spark, folder, "documents"), model, back=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
        "n_unlike",
    )


@query(
    f"""with known as (select sha256({_plain_sql("text")}) as digest, licence
      from (values {", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in licences.catalogue())}) k(licence, text)
      union all select digest, licence from (values {", ".join(f"('{n}', '{d}')" for n, d in licences.LONG)}) l(licence, digest)),
    names as (select digest, min(licence) as licence from known group by digest),
    rows as (select row_number() over () as nr, doc_id, coalesce(text, '') as text from documents),
    lines as (select distinct nr, {_plain_sql("line")} as line from (select nr, unnest(string_split(text, chr(10))) as line from rows)),
    notes as (select nr, string_agg(distinct licence, ',' order by licence) as notices
      from lines join names on digest = sha256(line) where line <> '' group by nr),
    whole as (select nr, doc_id, sha256({_plain_sql("text")}) as digest from rows)
    select doc_id, digest, licence, coalesce(notices, '') as notices
    from whole left join names using (digest) left join notes using (nr)"""
)
def op7_licences(spark, folder):
    found = licences.scan(read(spark, folder, "documents"))
    return found.select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


@query(
    """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
      where embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
    scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
    select query_id, rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored) where rank <= 10"""
)
def op8_topk_search(spark, folder):
    return topk_search.top_k(read(spark, folder, "embeddings"), "vec_id % 100 = 0", 10, 1024)


@query()
def op9_language_model(spark, folder):
    return language_model.score(read(spark, folder, "documents"), 7, 2)


@query(
    """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') as ws from documents),
    sets as (select distinct doc_id, unnest(case when len(ws) >= 3
        then list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else []::varchar[] end) as s from w),
    sizes as (select doc_id, count(*) as n from sets group by doc_id),
    common as (select p.doc_id as a, q.doc_id as b, count(*) as o from sets p join sets q on p.s = q.s and p.doc_id <> q.doc_id group by 1, 2),
    links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o))"""
    + _COMPONENTS.format(edges="links")
    + """,
    roots as (select id, min(root) as root from reach group by id)
    select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) as component_id
    from documents d left join sizes using (doc_id) left join roots on roots.id = d.doc_id"""
)
def op10_jaccard_join(spark, folder):
    return jaccard_join.linked_texts(read(spark, folder, "documents"), 90, 3)


@query(
    """with docs as (select doc_id, upper(hex(encode(coalesce(text, '')))) as h from documents),
    starts as (select doc_id, unnest(range(0, length(h) // 2 - 49)) as s, h from docs where length(h) >= 100),
    strings as (select doc_id, s, substr(h, 2 * s + 1, 100) as w from starts),
    least as (select w, min(doc_id) as owner from strings group by w having count(distinct doc_id) > 1),
    hits as (select doc_id, s from strings join least using (w) where owner < doc_id),
    gone as (select distinct doc_id, s + k as i from hits, range(0, 50) r(k)),
    bytes as (select doc_id, unnest(range(0, length(h) // 2)) as i, h from docs),
    marked as (select b.doc_id, b.i, substr(b.h, 2 * b.i + 1, 2) as x, g.i is not null as out from bytes b left join gone g on g.doc_id = b.doc_id and g.i = b.i),
    runs as (select *, coalesce(lag(out) over (partition by doc_id order by i), false) as before from marked),
    sums as (select doc_id, count(*) filter (out) as n_removed, count(*) filter (out and not before) as n_spans,
      coalesce(string_agg(case when not out then x end, '' order by i), '') as kept from runs group by doc_id)
    select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
      sha256(unhex(coalesce(kept, ''))) as kept_sha256
    from docs d left join sums using (doc_id)"""
)
def op6_suffix_dedup(spark, folder):
    cut = suffix_dedup.repeated_passages(read(spark, folder, "documents"), 50)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op11_complement_packing(spark, folder):
    pieces = complement_packing.pack_tightly(read(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), 2048, 0)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query(
    """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
      where label is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
    scored as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.e, c.e)::bigint as score
      from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
    positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
      vec_id as negative_id, positive_score, score as negative_score
    from positives join scored using (anchor_id)
    where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
    qualify rank <= 3"""
)
def op12_hard_negatives(spark, folder):
    rows = read(spark, folder, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.expr("(label + 1) % 10")).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, "vec_id % 50 = 0", 5, 3, 50, 95, 256)


@query(
    """with pieces as (select row_number() over () as piece, lang, piece_text from (select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece_text from documents)),
    w as (select lang, regexp_extract_all(piece_text, '[^\x20\x09]+') as ws from pieces),
    totals as (select lang, sum(len(ws))::hugeint as n from w group by lang),
    grams as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase
      from w, range(1, 6) t(k) where len(ws) >= k),
    f as (select lang, k, phrase, count(*)::hugeint as a from grams group by all having count(*) >= 100),
    parts as (select lang, k, phrase, a, string_split(phrase, ' ') as p from f where k > 1),
    inside as (select distinct q.lang, array_to_string(q.p[i : i + s - 1], ' ') as phrase, q.a
      from parts q, range(2, 5) sizes(s), range(1, 5) starts(i) where s < q.k and i + s - 1 <= q.k),
    within as (select lang, phrase, max(a) as longest from inside group by all),
    cuts as (select c.lang, c.phrase, c.a, x.a as l, y.a as r, n, (1000 * c.a * n) // (x.a * y.a) as score, j
      from parts c, range(1, 5) cut(j), f x, f y, totals t
      where j < c.k and x.lang = c.lang and x.phrase = array_to_string(c.p[1 : j], ' ') and y.lang = c.lang and y.phrase = array_to_string(c.p[j + 1 : c.k], ' ') and t.lang = c.lang),
    scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1)
    select s.lang, row_number() over (partition by s.lang order by score desc, s.a desc, s.phrase) as rank, s.phrase,
      s.a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
    from scored s left join within v on v.lang = s.lang and v.phrase = s.phrase where longest is null or 100 * longest < 100 * s.a
    qualify rank <= 2000"""
)
def op13_collocations(spark, folder):
    return collocations.collocations(read(spark, folder, "documents"), 100, 5, 2000)
