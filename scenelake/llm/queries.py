"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import classifier

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, _read(spark, sf_dir, "labels").filter(_fold(3) != 1))
    got = classifier.scored(docs, model)
    return got.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    vocabulary = _path("byte_bpe_50k.json")
    got = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return got.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    got = token_counts.token_counts(_read(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exchange, token_files

    folder = exchange.workdir(spark)
    got = token_files.read(spark, token_files.write(_read(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), folder))
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exchange, web_archives

    got = web_archives.read(spark, web_archives.write(_read(spark, sf_dir, "pages"), exchange.workdir(spark)))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    got = repeats.cut(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_model

    return language_model.scores(_read(spark, sf_dir, "documents"), _fold(7) != 2)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    got = decontaminate.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = _read(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    got = quality_rules.judged(docs, quality_rules.fit(docs, trusted))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_duplicates

    got = near_duplicates.groups(_read(spark, sf_dir, "documents"), shingle=2)
    return got.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


#: Rules of op11: action, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_rules

    got = url_rules.judged(_read(spark, sf_dir, "pages").select("page_id", "url", "html"), [url_rules.Rule(*x) for x in URL_RULES])
    return got.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op12_leaderboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import leaderboards

    return leaderboards.feed(*(_read(spark, sf_dir, t) for t in ("sale_lines", "items", "vendors")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.divergences(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_bpe, op3_token_counts, op4_token_files, op5_repeats, op6_language_model, op7_decontaminate, op8_quality_rules, op9_near_duplicates, op10_warc, op11_urls, op12_leaderboards, op13_divergence)}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
SQL: dict[str, str] = {
    "op7_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} FROM documents), b AS (SELECT item_id, {_WORDS} FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
          FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS key
          FROM (SELECT d.*, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) s WHERE len(w) >= s.n)),
        hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win USING (n, key)),
        cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
        ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op12_leaderboards": """
        WITH t AS (SELECT *, concat(CAST(sale_id AS VARCHAR), ',', CAST(item_id AS VARCHAR), ',', CAST(vendor_id AS VARCHAR), ',', CAST(line_no AS VARCHAR)) AS key FROM sale_lines),
        -- crc32 bit by bit: the next byte is added at each eighth step
        c AS (SELECT *, xor(list_reduce(range(CAST(8 * length(key) AS BIGINT)),
            lambda a, i: xor(xor(a, CASE WHEN i % 8 = 0 THEN ascii(key[i // 8 + 1]) ELSE 0 END) >> 1, 3988292384 * (xor(a, CASE WHEN i % 8 = 0 THEN ascii(key[i // 8 + 1]) ELSE 0 END) & 1)), 4294967295), 4294967295) AS h FROM t),
        d AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)), 19723 + h % 150) AS s FROM c),
        a AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS arrival_day FROM d),
        b AS (SELECT *, CAST(greatest(1, least(12, 1 + floor((arrival_day - 19723) * 12 / 180.0))) AS INTEGER) AS batch FROM a),
        seen AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM b GROUP BY batch),
        kept AS (SELECT nation_id, b.item_id, batch, arrival_day,
            CASE WHEN flag = 'returned' THEN -1.0 ELSE 1.0 END::DOUBLE * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0) AS cents
          FROM b JOIN seen USING (batch) JOIN items i ON i.item_id = b.item_id JOIN vendors v ON v.vendor_id = b.vendor_id
          WHERE nation_id IS NOT NULL AND (latest IS NULL OR s + 8 >= latest)),
        steps AS (SELECT nation_id, item_id, arrival_day, sum(sum(cents)) OVER (PARTITION BY nation_id, item_id ORDER BY arrival_day) AS cents FROM kept GROUP BY nation_id, item_id, arrival_day),
        days AS (SELECT nation_id, arrival_day, batch, row_number() OVER (PARTITION BY nation_id ORDER BY arrival_day) AS k FROM (SELECT DISTINCT nation_id, arrival_day, batch FROM kept)),
        spans AS (SELECT nation_id, item_id, k AS since, lead(k) OVER (PARTITION BY nation_id, item_id ORDER BY k) AS until, cents FROM steps JOIN days USING (nation_id, arrival_day)),
        daily AS (SELECT d.nation_id, d.k, item_id, cents FROM days d JOIN spans s ON s.nation_id = d.nation_id AND d.k >= since AND (until IS NULL OR d.k < until)),
        board AS (SELECT nation_id, k, item_id, CAST(row_number() OVER (PARTITION BY nation_id, k ORDER BY cents DESC, item_id) AS INTEGER) AS place FROM daily WHERE cents > 0 QUALIFY place <= 10),
        diff AS (SELECT coalesce(n.nation_id, o.nation_id) AS nation_id, coalesce(n.k, o.k + 1) AS k, coalesce(n.item_id, o.item_id) AS item_id, o.place AS old_rank, n.place AS new_rank
          FROM board n FULL JOIN board o ON n.nation_id = o.nation_id AND n.k = o.k + 1 AND n.item_id = o.item_id WHERE n.place IS DISTINCT FROM o.place)
        SELECT nation_id, arrival_day, item_id, batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank, new_rank, CAST(cents AS BIGINT) AS revenue
        FROM diff JOIN days USING (nation_id, k) JOIN daily USING (nation_id, k, item_id)""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        occ AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY ALL HAVING count(DISTINCT id) >= 30),
        held AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY ALL),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        grp AS (SELECT lang, source, coalesce(max(v), 0) AS v, coalesce(sum(n), 0) AS total
          FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN held USING (lang, source) LEFT JOIN langs USING (lang) GROUP BY ALL),
        share AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
            1 + (1000000000 * (coalesce(h.n, 0) + 5)::HUGEINT) // (g.total + 5 * g.v) AS p, 1 + (1000000000 * (k.n + 5)::HUGEINT) // (l.total + 5 * l.v) AS q
          FROM grp g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
        far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
          FROM (FROM pair UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM share WHERE n > 0 AND p > q))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, payload_bytes,
          array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1) for i in range(32)], '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id > first THEN first END AS refers_to
        FROM d""",
}


def _share(part: str, whole: str, mass: str) -> str:
    return f"({mass} // {whole}) * {part} + (({mass} % {whole}) * {part}) // {whole}"


def _urls_sql(rounds: int = 20) -> str:
    """The rounds of op11 are written out, as a recursive query may not sum."""
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    link = r"""[hH][rR][eE][fF][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["'']?[\x20\x09-\x0D]*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"''<>\x20\x09-\x0D]+)"""
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
    steps = "".join(
        f"""
        m{k} AS (SELECT dst AS host, kind, CAST(sum({_share('w.n', 'whole', '(mass // 100 * 85)')}) AS BIGINT) AS mass FROM m{k - 1} JOIN ways w USING (host, kind) GROUP BY ALL),"""
        for k in range(1, rounds + 1)
    )
    return f"""
        WITH p AS (SELECT row_number() OVER () AS id, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        u AS (SELECT id, page_id, html, coalesce(translate(regexp_extract(rest, '\\A([^/?#]*)', 1), {lower}), '') AS host, coalesce(regexp_extract(rest, '\\A[^/?#]*([^?#]*)', 1), '') AS path FROM p),
        rules AS (SELECT * FROM (VALUES {rules}) t(action, rh, rp)),
        fits AS (SELECT id, arg_max(action, length(rh || rp)) AS action, arg_max(rh || rp, length(rh || rp)) AS rule
          FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY id),
        hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (action = 'allow') * 1000 // count(*) AS trust, count(*) FILTER (action = 'block') * 1000 // count(*) AS distrust
          FROM u LEFT JOIN fits USING (id) WHERE host <> '' GROUP BY host),
        edges AS (SELECT src, dst, count(*) AS n FROM (SELECT DISTINCT id, host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {lower}) AS dst FROM u) WHERE src <> '' AND src <> dst GROUP BY ALL),
        ways AS (SELECT *, CAST(sum(n) OVER (PARTITION BY host, kind) AS BIGINT) AS whole
          FROM (SELECT src AS host, dst, 'trust' AS kind, n FROM edges UNION ALL SELECT dst, src, 'distrust', n FROM edges)),
        seeds AS (SELECT host, 'trust' AS kind, trust AS seed FROM hosts UNION ALL SELECT host, 'distrust', distrust FROM hosts),
        m0 AS (SELECT host, kind, {_share('seed', 'CAST(total AS BIGINT)', '100000000000000000')} AS mass FROM seeds JOIN (SELECT kind, sum(seed) AS total FROM seeds GROUP BY kind HAVING sum(seed) > 0) USING (kind)),{steps}
        mass AS (SELECT host, CAST(coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS BIGINT) AS distrust
          FROM ({' UNION ALL '.join(f'FROM m{k}' for k in range(rounds + 1))}) GROUP BY host),
        known AS (SELECT host, coalesce(m.trust, 0) AS trust, coalesce(m.distrust, 0) AS distrust FROM hosts LEFT JOIN mass m USING (host)),
        mean AS (SELECT coalesce(sum(distrust), 0) // greatest(count(*), 1) AS mean FROM known)
        SELECT page_id, u.host, path, rule, coalesce(action, CASE WHEN distrust > trust AND distrust >= mean THEN 'block' ELSE 'allow' END) AS verdict,
          coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
        FROM u LEFT JOIN fits USING (id) LEFT JOIN known ON known.host = u.host CROSS JOIN mean"""


SQL["op11_urls"] = _urls_sql()
