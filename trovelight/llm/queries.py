"""The operators of this folder as queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.llm import bpe, chat, exact, language, licenses, near, ngram_join, packing, pii, quality, resampling, warc, whitening
from trovelight.llm.common import new_path, written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    packed = packing.packed_documents(documents, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rated = quality.rated(documents).select("doc_id", "quality.*")
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    warc.registered(spark)
    path = new_path(spark, "warc")
    warc.as_records(table(spark, folder, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    return back.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    back = written(chat.examples(conversations.unionByName(own)), "chat")
    trained = chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    each = back.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", trained.alias("text"))))).alias("trained"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    turns = each.select("conv_id", chat.turns_of(F.col("whole")).alias("turns"), F.array_join("trained.text", "").alias("loss"), "formatted_chars")
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(body, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        "doc_id", "text", F.sha2(exact.normalised(F.col("text")), 256).alias("text_sha256")
    )
    groups = exact.equal_texts(documents, carry=["doc_id", "text_sha256"])
    return groups.select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = pii.train(documents)
    spans = pii.found_spans(documents, model).select("doc_id", "base", "added")
    kinds = F.array(*[F.lit(kind) for kind in pii.KINDS])
    in_order = F.array_sort(
        F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return spans.select(
        "doc_id",
        *[count(kind).cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(in_order).alias("spans"),
    )


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.learned(documents.where(F.col("doc_id").isNotNull() & ~held).select("text", "lang"))
    found = language.predicted(documents.select("doc_id", "text"), model, ["doc_id"])
    return found.select("row.doc_id", language.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scanned(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(spans)), ",")
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "found.label")).alias("labels"),
        "score",
    )


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return near.near_classes(documents).select("row.doc_id", "class_id", "class_size", "kept")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = bpe.encoded(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
    return found.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "n_shingles", "component_id")


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fitted(vectors)
    error = whitening.identity_error(vectors, model) if model is not None else 0.0
    explained = F.array(*[F.lit(float(share)) for share in ([] if model is None else model.explained)]).cast("array<double>")
    each = whitening.whitened(vectors, model, carry=["vec_id"]).select("row.vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n if model is not None else 0).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling.drawn(table(spark, folder, "documents"), table(spark, folder, "benchmark"), carry=["doc_id"])
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_bpe": op10_bpe,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_importance_resampling": op13_importance_resampling,
}

SQL = {
    "op2_quality_rules": r"""
        with texts as (select doc_id, coalesce(text, '') as body from documents),
        split as (
            select doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as words,
                list_filter(string_split(body, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) as lines
            from texts
        ),
        windows as (
            select doc_id, unnest(range(1, len(words) - 1)) as place,
                unnest(list_transform(range(1, len(words) - 1), lambda i: [words[i], words[i + 1], words[i + 2]])) as three
            from split
        ),
        twice as (select doc_id, three from windows group by doc_id, three having count(*) > 1),
        covered as (
            select doc_id, count(distinct place + step) as n from windows join twice using (doc_id, three), range(3) as steps(step)
            group by doc_id
        ),
        measured as (
            select doc_id, len(words) as n_words,
                coalesce(list_sum(list_transform(words, lambda word: length(word))), 0)::bigint as word_chars,
                length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
                len(lines) as n_lines, length(regexp_replace(body, '[^!]', '', 'g')) as n_exclamations,
                length(regexp_replace(body, '\P{Lu}', '', 'g')) as n_capitals, length(regexp_replace(body, '\P{L}', '', 'g')) as n_letters
            from split left join covered using (doc_id)
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
            not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or 10 * n_exclamations > 3 * n_words
                or 10 * n_capitals > 3 * n_letters or 10 * n_dup_lines > 4 * n_lines) as kept
        from measured
    """,
    "op3_warc": r"""
        with payloads as (
            select page_id, coalesce(html, '') as body, upper(sha1(coalesce(html, ''))) as hexed from pages
        ),
        letters as (
            select page_id, body,
                list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    1 + ((('0x' || substr(hexed, 5 * (i // 4) + 1, 5))::int >> (15 - 5 * (i % 4))) & 31), 1)), lambda a, b: a || b) as digest,
                max(page_id) over (partition by body) as kept
            from payloads
        )
        select page_id, strlen(body) as payload_bytes, digest as payload_digest,
            case when page_id = kept then 'response' else 'revisit' end as record_type,
            case when page_id <> kept then kept end as refers_to
        from letters
    """,
    "op4_chat_formatting": r"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        sized as (
            select *, 14 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) as chars,
                row_number() over turns as place, count(*) over (partition by conv_id) as n
            from rows window turns as (partition by conv_id order by turn nulls last, role, text)
        ),
        prefixes as (
            select *, sum(chars) over (partition by conv_id order by place) as prefix from sized
        )
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
            (sum(prefix) filter (role = 'assistant' or place = n))::bigint as formatted_chars
        from prefixes group by conv_id
    """,
    "op5_exact_dedup": r"""
        with normal as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
        )
        select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
            doc_id = min(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
        from normal
    """,
    "op11_ngram_jaccard_join": r"""
        with recursive split as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
            from documents
        ),
        shingles as (
            select distinct doc_id, unnest(case when len(words) between 1 and 2 then [words]
                else list_transform(range(1, len(words) - 1), lambda i: [words[i], words[i + 1], words[i + 2]]) end) as shingle
            from split where words is not null
        ),
        numbered as (select doc_id, hash(shingle) as h, shingle from shingles),
        sized as (select doc_id, count(*) as n from shingles group by doc_id),
        sets as (
            select doc_id, n, md5(string_agg(h::varchar, ',' order by h)) as content from numbered join sized using (doc_id) group by doc_id, n
        ),
        -- Equal sets are one node, so that copies are not paired with each other.
        nodes as (select content, n, min(doc_id) as node from sets group by content, n),
        common as (
            select a.doc_id as a, b.doc_id as b, count(*) as n_common
            from numbered a join numbered b on a.shingle = b.shingle and a.doc_id < b.doc_id
            where a.doc_id in (select node from nodes) and b.doc_id in (select node from nodes)
            group by 1, 2
        ),
        links as (
            select a, b from common join nodes x on x.node = a join nodes y on y.node = b where 100 * n_common >= 90 * (x.n + y.n - n_common)
        ),
        edges as (select a as x, b as y from links union select b, a from links),
        reach as (
            select node, node as other from nodes
            union
            select node, y from reach join edges on other = x
        ),
        components as (select node, min(other) as component from reach group by node)
        select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(component, d.doc_id) as component_id
        from documents d left join sets s using (doc_id) left join nodes n on n.content = s.content and n.n = s.n
            left join components c on c.node = n.node
    """,
    "op13_importance_resampling": r"""
        with texts as (
            select 'd' as side, doc_id, coalesce(text, '') as body from documents
            union all select 't', item_id, coalesce(text, '') from benchmark
        ),
        split as (
            select side, doc_id, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from texts
        ),
        runs as (
            select side, doc_id, unnest(list_concat(words,
                list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
                list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) as run
            from split
        ),
        bytes as (
            select b, list_reduce(list_prepend(b::bigint, range(8)),
                lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as entry
            from range(256) as r(b)
        ),
        entries as (select list(entry order by b) as entry from bytes),
        hashed as (
            select run, list_reduce(
                list_prepend(4294967295::bigint, list_transform(range(0, length(hexed) // 2), lambda i: ('0x' || substr(hexed, (2 * i + 1)::bigint, 2))::bigint)),
                lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])) as state
            from (select run, hex(encode(run)) as hexed from runs group by run), entries
        ),
        buckets as (select run, xor(state, 4294967295) % 10000 as bucket from hashed),
        placed as (select side, doc_id, bucket from runs join buckets using (run)),
        counted as (
            select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from placed group by bucket
        ),
        totals as (select count(*) filter (side = 'd') as s_all, count(*) filter (side = 't') as t_all from placed),
        gains as (
            select bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::double / ((s + 1) * (t_all + 10000))::double))::bigint as gain from counted, totals
        ),
        weights as (
            select doc_id, count(*) as n_features, sum(gain)::bigint as weight from placed join gains using (bucket) where side = 'd' group by doc_id
        ),
        scored as (
            select d.doc_id, len(d.words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
            from split d left join weights using (doc_id) where side = 'd'
        ),
        ranked as (
            select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_words >= 20
        )
        select doc_id, n_features, weight, score, case when place <= 5 * n // 100 then place end as rank
        from scored left join ranked using (doc_id)
    """,
}
