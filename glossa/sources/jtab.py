"""The analysed-text format: records of sentences, phrases, basic phrases and morphemes that end with EOS.

`spark.read.format("jtab").load(path)` gives one row per record with nested arrays; `write.format("jtab")` prints it
again. A malformed record doesn't fail the read: it has `error` and no morphemes. Paths are read by Spark's own text
reader (`read_jtab`), so any file system works and one file splits into many tasks; the DataSource is for
sessions that want the format's name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MORPH = "surface string, reading string, lemma string, pos string, pos_id int, subpos string, subpos_id int, infl_type string, infl_type_id int, infl_form string, infl_form_id int, sem string, features array<string>"
SCHEMA = (
    "article_id string, sent_id string, sent_no int, comment string, "
    "phrases array<struct<head: int, dep_type: string, features: array<string>>>, "
    "basic_phrases array<struct<phrase_no: int, head: int, dep_type: string, features: array<string>>>, "
    f"morphemes array<struct<{', '.join(x.replace(' ', ': ', 1) for x in MORPH.split(', '))}, phrase_no: int, bp_no: int, alternative_of: int>>, error string"
)
HEAD = re.compile(r"(-?\d+)([A-Z])$")
FEATURE = re.compile(r"<((?:[^<>\\]|\\.)*)>")
#: Columns end at a space of ASCII alone: other white space may be part of a word.
MORPHEME = re.compile(r"([^ ]+|  ?) ([^ ]+|  ?) ([^ ]+|  ?) ([^ ]+) (\d+) ([^ ]+) (\d+) ([^ ]+) (\d+) ([^ ]+) (\d+)(?: (.*))?$", re.DOTALL)
COLUMNS = ("surface", "reading", "lemma", "pos", "pos_id", "subpos", "subpos_id", "infl_type", "infl_type_id", "infl_form", "infl_form_id")
#: How many records are held as arrays at a time.
CHUNK = 1000


class Malformed(ValueError):
    pass


def _features(text: str) -> list[str]:
    return [re.sub(r"\\(.)", r"\1", f) for f in FEATURE.findall(text)]


def _unit(line: str) -> tuple[int | None, str | None, list[str]]:
    fields = line.split(" ", 2)
    if len(fields) == 1:
        return None, None, []
    m = HEAD.match(fields[1])
    if not m:
        raise Malformed(f"dependency expected: {line[:60]}")
    return int(m[1]), m[2], _features(fields[2]) if len(fields) > 2 else []


def _morpheme(line: str) -> dict[str, Any]:
    m = MORPHEME.match(line)
    if not m:
        raise Malformed(f"11 or 12 columns expected: {line[:60]}")
    sem, features = _rest(m[12] or "")
    values = [int(v) if n.endswith("_id") else v for n, v in zip(COLUMNS, m.groups()[:11], strict=True)]
    return dict(zip(COLUMNS, values, strict=True)) | {"sem": sem, "features": features}


def _rest(rest: str) -> tuple[str | None, list[str]]:
    """The sem column and the features, from what follows the eleventh column."""
    sem, features = None, []
    if rest:
        quoted = re.match(r'"((?:[^"\\]|\\.)*)"\s*', rest)
        if quoted:
            sem, rest = re.sub(r"\\(.)", r"\1", quoted[1]), rest[quoted.end() :]
        elif not rest.startswith("<"):
            sem, _, rest = rest.partition(" ")
        features = _features(rest)
    return None if sem == "NIL" else sem, features


def _header(line: str) -> dict[str, Any]:
    m = re.match(r"# S-ID:(\S+)\s*(.*)$", line)
    out = {"article_id": None, "sent_id": None, "sent_no": None, "comment": (m[2] if m else line[2:]) or None}
    if m:
        article, dash, number = m[1].rpartition("-")
        out |= {"sent_id": m[1], "article_id": article if dash else m[1], "sent_no": int(number) if number.isdigit() else None}
    return out


def parse_record(text: str, ignore: str = "") -> dict[str, Any] | None:
    """One record without its EOS; None where it is blank. Lines that start with `ignore` are skipped."""
    out: dict[str, Any] = {"article_id": None, "sent_id": None, "sent_no": None, "comment": None, "phrases": [], "basic_phrases": [], "morphemes": [], "error": None}
    lines = [x for x in text.split("\n") if x and not (ignore and x.startswith(ignore))]
    if not lines:
        return None
    last = -1
    try:
        for line in lines:
            if line.startswith("# ") and not out["morphemes"] and not MORPHEME.match(line):  # a first word may be #
                out |= {k: v for k, v in _header(line).items() if v is not None or k == "comment"}
            elif re.match(r"\*(?:$| -?\d+[A-Z](?:$| ))", line):
                head, kind, features = _unit(line)
                out["phrases"].append({"head": head, "dep_type": kind, "features": features})
            elif re.match(r"\+(?:$| -?\d+[A-Z](?:$| ))", line):
                head, kind, features = _unit(line)
                out["basic_phrases"].append({"phrase_no": len(out["phrases"]) - 1, "head": head, "dep_type": kind, "features": features})
            else:
                alternative = line.startswith("@ ") and not line.startswith("@ @ @ ") and last >= 0
                own = _morpheme(line[2:] if alternative else line)
                place = {"phrase_no": len(out["phrases"]) - 1, "bp_no": len(out["basic_phrases"]) - 1}
                out["morphemes"].append(own | place | {"alternative_of": last if alternative else None})
                if not alternative:
                    last = len(out["morphemes"]) - 1
    except Malformed as e:
        out |= {"phrases": [], "basic_phrases": [], "morphemes": [], "error": str(e)}
    return out


def format_record(r: dict[str, Any]) -> str:
    """The record as text with its EOS; parse_record reads it back."""
    escape = lambda f: re.sub(r"([<>\\])", r"\\\1", f)
    marks = lambda fs: "".join(f"<{escape(f)}>" for f in fs or ())
    lines = []
    if r["sent_id"] is not None:
        lines.append(f"# S-ID:{r['sent_id']}" + (f" {r['comment']}" if r["comment"] else ""))
    elif r["comment"]:
        lines.append(f"# {r['comment']}")
    if r["error"]:
        return "\n".join([*lines, "EOS\n"])

    def unit(mark: str, u: dict[str, Any]) -> str:
        return mark if u["head"] is None else f"{mark} {u['head']}{u['dep_type']} {marks(u['features'])}".rstrip()

    phrase = basic = -1
    for m in r["morphemes"]:
        while phrase < m["phrase_no"]:
            phrase += 1
            lines.append(unit("*", r["phrases"][phrase]))
        while basic < m["bp_no"]:
            basic += 1
            lines.append(unit("+", r["basic_phrases"][basic]))
        columns = [str(m[c]) for c in COLUMNS]
        sem = "NIL" if m["sem"] is None else '"' + re.sub(r'(["\\])', r"\\\1", m["sem"]) + '"'
        lines.append("@ " * (m["alternative_of"] is not None) + " ".join([*columns, sem]) + (" " + marks(m["features"]) if m["features"] else ""))
    return "\n".join([*lines, "EOS\n"])


def arrow_schema():
    """SCHEMA as an Arrow schema."""
    import pyarrow as pa

    text, number = pa.string(), pa.int32()
    unit = [("head", number), ("dep_type", text), ("features", pa.list_(text))]
    morpheme = [(c, number if c.endswith("_id") else text) for c in COLUMNS] + [("sem", text), ("features", pa.list_(text)), ("phrase_no", number), ("bp_no", number), ("alternative_of", number)]
    return pa.schema(
        [("article_id", text), ("sent_id", text), ("sent_no", number), ("comment", text), ("phrases", pa.list_(pa.struct(unit))),
         ("basic_phrases", pa.list_(pa.struct([("phrase_no", number), *unit]))), ("morphemes", pa.list_(pa.struct(morpheme))), ("error", text)]
    )


def parse_records(texts, ignore: str = "") -> list:
    """parse_record of an Arrow array of texts, as Arrow batches in no order. Records of a header and plain morphemes, which is what
    analysers without phrases write, are cut by column; the rest line by line."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = arrow_schema()
    lists = pc.split_pattern(texts, "\n")
    lines, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    blank = pc.equal(lines, "")
    if ignore:
        blank = pc.or_(blank, pc.starts_with(lines, ignore))
    keep = ~blank.to_numpy(zero_copy_only=False)
    lines, of = lines.filter(pa.array(keep)), of[keep]
    if not len(lines):
        return []
    parts = pc.split_pattern(lines, " ", max_splits=11)
    at, n = parts.offsets.to_numpy()[:-1], pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    wide = n >= 11
    cut = [parts.values.take(pa.array(at[wide] + k)) for k in range(11)]
    mask = lambda x: x.to_numpy(zero_copy_only=False)
    good = np.ones(len(cut[0]), bool)
    for name, column in zip(COLUMNS, cut, strict=True):
        good &= mask(pc.match_substring_regex(column, "^[0-9]{1,9}$")) if name.endswith("_id") else mask(pc.not_equal(column, ""))
    plain = wide.copy()
    plain[wide] = good
    plain &= ~mask(pc.match_substring_regex(lines, r"^(?:[*+](?: -?[0-9]+[A-Z])?(?: |$)|@ )")) | mask(pc.match_substring_regex(lines, r"^(?:[*] [*] [*] |[+] [+] [+] |@ @ @ )"))
    first = np.r_[True, of[1:] != of[:-1]]
    header = first & ~plain & mask(pc.starts_with(lines, "# ")) & ~wide
    other = np.zeros(len(texts), bool)
    other[of[~plain & ~header]] = True
    out = []
    if other.any():
        rows = [parse_record(t, ignore) for t in texts.filter(pa.array(other)).to_pylist()]
        out.append(pa.RecordBatch.from_pylist([r for r in rows if r], schema=schema))
    own = ~other[of]
    if own.any():
        took = (plain & own)[wide]
        columns = [c.filter(pa.array(took)) for c in cut]
        columns = [c.cast(pa.int32()) if name.endswith("_id") else c for name, c in zip(COLUMNS, columns, strict=True)]
        here = plain & own
        rest = pa.array(np.where(n[here] > 11, at[here] + 11, -1))
        rest = pc.fill_null(parts.values.take(pc.if_else(pc.less(rest, 0), None, rest)), "").dictionary_encode()
        told = [_rest(t) for t in rest.dictionary.to_pylist()]
        sem = pa.array([t[0] for t in told], pa.string()).take(rest.indices)
        features = pa.array([t[1] for t in told], pa.list_(pa.string())).take(rest.indices)
        size = len(rest)
        minus = pa.array(np.full(size, -1, np.int32))
        kind = schema.field("morphemes").type.value_type
        morphemes = pa.StructArray.from_arrays([*columns, sem, features, minus, minus, pa.nulls(size, pa.int32())], fields=list(kind))
        records = of[first & own]
        counts = np.bincount(of[here], minlength=len(texts))[records]
        nested = pa.ListArray.from_arrays(pa.array(np.r_[0, counts.cumsum()].astype(np.int32)), morphemes)
        heads: list[dict[str, Any]] = [{}] * len(records)
        for i, line in zip(np.searchsorted(records, of[header & own]).tolist(), lines.filter(pa.array(header & own)).to_pylist(), strict=True):
            heads[i] = _header(line)
        found = [pa.array([h.get(c) for h in heads], schema.field(c).type) for c in ("article_id", "sent_id", "sent_no", "comment")]
        empty = [pa.array([[]] * len(records), schema.field(c).type) for c in ("phrases", "basic_phrases")]
        out.append(pa.RecordBatch.from_arrays([*found, *empty, nested.cast(schema.field("morphemes").type), pa.nulls(len(records), pa.string())], schema=schema))
    return out


def format_records(records) -> Any:
    """format_record without its last line break of an Arrow batch, as an Arrow array in no order: records of plain morphemes by
    column, the rest one by one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    mask = lambda x: x.to_numpy(zero_copy_only=False)
    size = lambda x: mask(pc.fill_null(pc.list_value_length(x), 0))
    lists = records["morphemes"]
    other = (size(records["phrases"]) > 0) | (size(records["basic_phrases"]) > 0) | mask(pc.fill_null(pc.not_equal(records["error"], ""), False)) | mask(lists.is_null())
    ms, of = lists.flatten(), mask(pc.list_parent_indices(lists))
    field = lambda c: pc.struct_field(ms, c)
    odd = mask(field("sem").is_valid()) | (size(field("features")) > 0) | mask(field("alternative_of").is_valid()) | mask(ms.is_null())
    for c in ("phrase_no", "bp_no"):
        odd |= mask(pc.fill_null(pc.greater_equal(field(c), 0), True))
    for c in COLUMNS:
        odd |= mask(field(c).is_null())
    other[of[odd]] = True
    out = []
    if other.any():
        out.append(pa.array([format_record(r).removesuffix("\n") for r in records.filter(pa.array(other)).to_pylist()], pa.string()))
    if not other.all():
        own = pa.array(~other[of])
        lines = pc.binary_join_element_wise(*[field(c).filter(own).cast(pa.string()) for c in COLUMNS], "NIL", " ")
        counts = size(lists)[~other]
        body = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, counts.cumsum()].astype(np.int32)), lines), "\n")
        body = pc.if_else(pa.array(counts > 0), body, None)
        ids, comments = (records[c].filter(pa.array(~other)).to_pylist() for c in ("sent_id", "comment"))
        heads = [f"# S-ID:{i}" + (f" {c}" if c else "") if i is not None else (f"# {c}" if c else None) for i, c in zip(ids, comments, strict=True)]
        out.append(pc.binary_join_element_wise(pa.array(heads, pa.string()), body, "EOS", "\n", null_handling="skip"))
    return pa.concat_arrays(out)


def read_jtab(spark: SparkSession, path: str, ignore: str = "") -> DataFrame:
    """The records of files, by Spark's text reader with EOS lines as separators."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                yield from parse_records(batch.column(0).slice(at, CHUNK), ignore)

    return spark.read.option("lineSep", "\nEOS\n").text(path).withColumn("value", F.regexp_replace("value", "\nEOS\n?$", "")).mapInArrow(run, SCHEMA)


def write_jtab(records: DataFrame, path: str, compression: str = "none", per_file: int = 0) -> None:
    """Records as text files, compressed if told (gzip takes an eighth). A compressed file is read by one task, so per_file bounds how many
    records it holds; 0 is one file per partition."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                yield pa.RecordBatch.from_arrays([format_records(batch.slice(at, CHUNK))], names=["value"])

    records.mapInArrow(run, "value string").write.option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def look_up(records: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """The records of some sentences: of a list of ids, or of a table (sent_id) by a join."""
    if isinstance(ids, DataFrame):
        return records.join(ids.select("sent_id").distinct(), "sent_id", "left_semi")
    return records.where(F.col("sent_id").isin(list(ids)))


RELATION = r"^rel:([^:]+):([^:]*)(?::([^:]*):(-?[0-9]+))?$"


def gold_relations(records: DataFrame) -> DataFrame:
    """(sent_id, bp_no, case, target, target_sent_id, target_bp_no) of the relations that annotators gave basic phrases, as features
    `rel:case:target` or `rel:case:target:sentence:unit`; without a sentence the target is the writer, the reader or outside."""
    flat = records.select("sent_id", F.posexplode("basic_phrases").alias("bp_no", "u")).select("sent_id", "bp_no", F.explode("u.features").alias("f")).where(F.col("f").startswith("rel:"))
    part = lambda i: F.regexp_extract("f", RELATION, i)
    told = lambda i: F.when(part(i) != "", part(i))
    return flat.where(part(1) != "").select("sent_id", "bp_no", part(1).alias("case"), part(2).alias("target"), told(3).alias("target_sent_id"), told(4).cast("int").alias("target_bp_no"))


def to_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The relational tables sentences, phrases, basic_phrases and morphemes."""
    key = F.col("sent_id")
    flat = lambda name, no: records.select(key, F.posexplode(name).alias(no, "u")).select("sent_id", no, "u.*")
    return {
        "sentences": records.select("article_id", "sent_id", "sent_no", "comment", "error"),
        "phrases": flat("phrases", "phrase_no"),
        "basic_phrases": flat("basic_phrases", "bp_no"),
        "morphemes": flat("morphemes", "morph_no"),
    }


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class JtabReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        info = system.get_file_info(path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [_Part(f.path) for f in files if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] else fs.LocalFileSystem()
        record: list[str] = []
        with system.open_input_stream(partition.path) as raw:
            import io

            for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace"):
                if line.rstrip("\n") != "EOS":
                    record.append(line)
                    continue
                parsed = parse_record("".join(record), self.options.get("ignore", ""))
                record = []
                if parsed:
                    yield _row(parsed)
        parsed = parse_record("".join(record), self.options.get("ignore", ""))
        if parsed:  # the last record may lack its EOS, as for read_jtab
            yield _row(parsed)


def _row(r: dict[str, Any]) -> tuple:
    units = [tuple(u.values()) for u in r["phrases"]]
    basics = [tuple(u.values()) for u in r["basic_phrases"]]
    return (r["article_id"], r["sent_id"], r["sent_no"], r["comment"], units, basics, [tuple(m.values()) for m in r["morphemes"]], r["error"])


@dataclass
class _Written(WriterCommitMessage):
    file: str


class JtabWriter(DataSourceWriter):
    """Tasks write into a folder of the job's own; the commit moves the files of the tasks that count and drops the rest, so a task
    that is run twice leaves no second copy."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, base = self._files()
        folder, name = f"{base}/_temporary-{self.job}", f"part-{uuid.uuid4().hex}.jtab"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for r in rows:
                out.write(format_record(r.asDict(recursive=True)).encode())
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, base = self._files()
        folder = f"{base}/_temporary-{self.job}"
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.is_file:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                system.move(f"{folder}/{m.file}", f"{base}/{m.file}")
        self._drop(system, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = self._files()
        self._drop(system, f"{base}/_temporary-{self.job}")

    @staticmethod
    def _drop(system, folder: str) -> None:
        if system.get_file_info(folder).type.name != "NotFound":
            system.delete_dir(folder)


class JtabDataSource(DataSource):
    """Options: path, ignore (a prefix of lines to skip)."""

    @classmethod
    def name(cls) -> str:
        return "jtab"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return JtabReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return JtabWriter(dict(self.options), overwrite)
