"""Queries of the binary and text sources, over cells made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from carillon.functions.vector import finite
from carillon.sources import container as K
from carillon.sources import lyrics as L
from carillon.sources import packages as P
from carillon.sources import reports as O
from carillon.sources import vectors as V
from carillon.sources import waves as W
from carillon.tables import load


def msim_roundtrip(s, d):
    """Vectors written as one document per folder of a thousand, and read again."""
    a = load(s, d, "analyzed").where(finite(F.col("vector")) & (F.size("vector") == 64))
    m = a.select(F.floor(F.col("analyzed_id") / 1000).cast("bigint").alias("doc"), F.lit("ab" * 32).alias("fingerprint"), F.lit(1).alias("disc"), (F.col("analyzed_id") % 1000 + 1).cast("int").alias("track"), F.when(F.col("analyzed_id") % 10 == 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status"), "vector")
    docs = V.write_documents(m, "doc", 64).select(F.col("doc").cast("string").alias("path"), "content")
    got = V.read_documents(docs)
    return got.select((F.col("path").cast("bigint") * 1000 + F.col("track") - 1).alias("analyzed_id"), "status", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda x, y: x + y), 5).alias("total"))


def blob_roundtrip(s, d):
    """Vectors to bytes and back; the digest of the bytes is the one that the table denotes where it isn't stale."""
    a = load(s, d, "analyzed").where("size(vector) > 0").select("analyzed_id", "vector", V.blob(F.col("vector")).alias("b"))
    return a.select("analyzed_id", F.sha2("b", 256).alias("digest"), F.size(V.floats(F.col("b"))).alias("dims"))


def half_roundtrip(s, d):
    """Numbers to half precision and back: the largest change, null where a number leaves the range."""
    e = load(s, d, "embeddings").select("vec_id", "embedding", W.from_half_bits(W.half_bits(F.col("embedding"))).alias("h"))
    return e.select("vec_id", F.round(F.array_max(F.zip_with("embedding", "h", lambda x, y: F.abs(x.cast("double") - y.cast("double")))), 8).alias("change"))


def lyrics_lines(s, d):
    """Lyrics among the documents, stamped line by line, read as timed documents: the lines must come back with their times."""
    t = load(s, d, "documents").where("lower(trim(source)) = 'lyrics' and text is not null")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    stamped = F.array_join(F.transform(lines, lambda x, i: F.concat(F.format_string("[%02d:%02d.%02d]", F.floor(i / 60), i % 60, i % 100), F.regexp_replace(x, r"^[\s\[]+|[<>]", ""))), "\n")
    got = L.read_lyrics(t.select("doc_id", F.concat(F.lit("[offset:+250]\n"), stamped).alias("text")))
    return got.groupBy("doc_id").agg(F.count("ts_ms").alias("n_lines"), F.max("ts_ms").alias("last_ms"), F.count("error").alias("faults"))


def wfm_roundtrip(s, d):
    """Waveforms packed to two bytes a bucket, and unpacked."""
    from carillon.plans.series import wave_buckets

    got = W.decode_wfm(W.encode_wfm(wave_buckets(s, d), "user_id"), "user_id")
    return got.select("user_id", F.col("bucket").cast("bigint").alias("bucket"), "peak", "rms")


def _in_folder(df, s, name):
    """Cells written as files: ``path`` below a fresh folder, ``content``; each file by the task that holds its row."""
    from carillon.session import stage_path

    root = stage_path(s, name)
    P.write_files(df, root)
    return root


def package_files(s, d):
    """Manifests laid in folders as packages, listed and told by name, with the limits that one scan may not pass."""
    m = load(s, d, "manifests").where("manifest is not null")
    n = F.col("manifest_id")
    name = F.concat(F.lit("p"), n.cast("string"), F.when(n % 9 == 0, F.lit("/album.mpack")).when(n % 7 == 0, F.lit("/notes.txt")).otherwise(F.lit("/manifest.json")))
    root = _in_folder(m.select(name.alias("path"), F.encode("manifest", "utf-8").alias("content")), s, "packages")
    files = P.list_files(s, root)
    return files.groupBy(P.kind_of(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def package_manifests(s, d):
    """The same packages' manifests read back with the digest of their bytes, and whether each is a whole one."""
    m = load(s, d, "manifests").where("manifest is not null")
    root = _in_folder(m.select(F.concat(F.lit("p"), F.col("manifest_id").cast("string"), F.lit("/manifest.json")).alias("path"), F.encode("manifest", "utf-8").alias("content")), s, "manifests")
    got = P.read_manifests(s, root)
    return got.select(F.regexp_extract("path", r"/p([0-9]+)/manifest\.json$", 1).cast("bigint").alias("manifest_id"), "sha256", "valid")


def container_members(s, d):
    """Texts packed ten to a container, and its blocks read again: members, index and tail with their lengths."""
    t = load(s, d, "documents").where("text is not null").select(F.floor(F.col("doc_id") / 10).cast("string").alias("box"), F.concat(F.lit("texts/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("member"), F.encode("text", "utf-8").alias("content"))
    boxes = K.pack_containers(t, "box", "member", "content")
    got = K.read_containers(boxes, "box", "content")
    return got.where("kind = 'member'").select(F.col("path").alias("box"), "member", "length")


def wav_samples(s, d):
    """Each user's values as a WAV stream of 16 bits, decoded again: frames and the sum of their samples."""
    e = load(s, d, "events")
    x = e.select("user_id", "event_id", (F.floor(F.col("value")).cast("int") * 32).alias("v"))
    wav = W.encode_wav(x, "user_id", "event_id", "v", 8000)
    return W.wav_frames(wav, "user_id").groupBy("user_id", "rate").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum(F.col("sample") * 32768)).cast("bigint").alias("total"))


def report_lines(s, d):
    """Names as lines of a report: quoted only where they must be."""
    return O.csv_lines(load(s, d, "artists").select("id", "name", "sort_name"))


def run_report(s, d):
    """A run of an experiment written as its document, read again as tracks and neighbours."""
    e = load(s, d, "embeddings").select("vec_id", "label", "embedding")
    near = e.select("vec_id", F.array(*(F.struct(((F.col("vec_id") * k) % 97).alias("index"), F.concat(F.lit("v/"), (F.col("vec_id") * k) % 97).alias("path"), (F.lit(1.0) / k).alias("score")) for k in (1, 2, 3))).alias("items"))
    docs = e.groupBy("label").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").alias("n"), F.struct(F.concat(F.lit("v/"), "vec_id").alias("path"), F.col("embedding").alias("vector")).alias("t")))).alias("t"))
    docs = docs.join(near.join(e.select("vec_id", "label"), "vec_id").groupBy("label").agg(F.collect_list(F.struct(F.col("vec_id").alias("query"), "items")).alias("neighbors")), "label")
    body = F.to_json(F.struct(F.transform("t", lambda x: x["t"]).alias("tracks"), "neighbors"))
    root = _in_folder(docs.select(F.concat(F.lit("run-"), F.col("label").cast("string"), F.lit(".json")).alias("path"), F.encode(body, "utf-8").alias("content")), s, "runs")
    tracks, found = O.read_run(s, root)
    none = F.lit(None).cast("bigint")
    a = tracks.agg(F.count(F.lit(1)).alias("tracks"), F.sum(F.size("vector")).alias("numbers")).select("tracks", "numbers", none.alias("neighbours"), none.alias("indexes"), none.alias("most"))
    b = found.agg(F.count(F.lit(1)).alias("neighbours"), F.sum("index").alias("indexes"), F.max("rank").cast("bigint").alias("most")).select(none.alias("tracks"), none.alias("numbers"), "neighbours", "indexes", "most")
    return a.unionByName(b).agg(*(F.max(c).alias(c) for c in a.columns))


QUERIES = {f.__name__: f for f in (msim_roundtrip, blob_roundtrip, half_roundtrip, lyrics_lines, wfm_roundtrip, package_files, package_manifests, container_members, wav_samples, report_lines, run_report)}
from carillon.plans.series import SQL as _SERIES  # noqa: E402

SQL = {
    "msim_roundtrip": "WITH g AS (SELECT analyzed_id, vector FROM analyzed WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x) OR isinf(x))) = 0) SELECT analyzed_id, CASE WHEN analyzed_id % 10 = 0 THEN 'failed' ELSE 'ok' END status, CASE WHEN analyzed_id % 10 <> 0 THEN round(list_sum(vector::DOUBLE[]), 5) END total FROM g",
    "lyrics_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) x FROM documents WHERE lower(trim(source)) = 'lyrics'), n AS (SELECT doc_id, count(*) n FROM l WHERE trim(x) <> '' GROUP BY 1) SELECT doc_id, n n_lines, (SELECT max((i.range // 60 * 60 + i.range % 60) * 1000 + i.range % 100 * 10) FROM range(5000) i WHERE i.range < n) + 250 AS last_ms, 0::BIGINT faults FROM n",
    "wfm_roundtrip": _SERIES["wave_buckets"],
    "package_files": "WITH m AS (SELECT CASE WHEN manifest_id % 9 = 0 THEN 'container' WHEN manifest_id % 7 = 0 THEN 'other' ELSE 'manifest' END kind, octet_length(encode(manifest)) b FROM manifests WHERE manifest IS NOT NULL) SELECT kind, count(*) n, sum(b)::BIGINT AS bytes FROM m GROUP BY 1",
    "container_members": "SELECT (doc_id // 10)::VARCHAR box, 'texts/' || lpad(doc_id::VARCHAR, 9, '0') AS member, octet_length(encode(text))::BIGINT AS length FROM documents WHERE text IS NOT NULL",
    "wav_samples": "SELECT user_id, 8000 AS rate, count(*) frames, sum(floor(value)::INT * 32)::BIGINT total FROM events GROUP BY 1",
    "report_lines": "WITH q AS (SELECT id, CASE WHEN regexp_matches(name, '[,\"\n\r]') THEN '\"' || replace(name, '\"', '\"\"') || '\"' ELSE name END n, CASE WHEN regexp_matches(sort_name, '[,\"\n\r]') THEN '\"' || replace(sort_name, '\"', '\"\"') || '\"' ELSE coalesce(sort_name, '') END s FROM artists) SELECT id || ',' || n || ',' || s AS line FROM q",
    "run_report": "SELECT count(*) tracks, sum(len(embedding))::BIGINT numbers, 3 * count(*) neighbours, sum(vec_id % 97 + vec_id * 2 % 97 + vec_id * 3 % 97)::BIGINT indexes, 3::BIGINT most FROM embeddings",
}
