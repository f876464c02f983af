"""Readers of memory maps, symbols, text traces, debug information, and graph tables."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators.lookup import with_running_sum

VMMAP_CSV = "start string, end string, offset string, perm string, res string, pres string, ref string, shd string, flag string, tp string, path string"


def vmmap(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, start, end, perm, flag, path) of a memory map: CSV if its lines have commas, else blank-separated with a process id first."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ordinal", "value")).where("trim(value) <> ''")
    comma = F.contains("value", F.lit(","))
    c = F.split("value", ",", 11)
    w = F.split(F.trim("value"), r"\s+", 11)
    part = lambda i, j: F.trim(F.when(comma, F.get(c, F.lit(i))).otherwise(F.get(w, F.lit(j))))
    start = F.when(comma, S.parse_int(F.get(c, F.lit(0)))).otherwise(S.parse_hex(F.get(w, F.lit(1))))
    end = F.when(comma, S.parse_int(F.get(c, F.lit(1)))).otherwise(S.parse_hex(F.get(w, F.lit(2))))
    return lines.select("ordinal", start.alias("start"), end.alias("end"), F.coalesce(part(3, 3), F.lit("")).alias("perm"), F.coalesce(part(8, 8), F.lit("")).alias("flag"), F.coalesce(part(10, 10), F.lit("")).alias("path")).where("start is not null and end is not null")


def stack_map(maps: DataFrame) -> DataFrame:
    """The first row that grows down."""
    return maps.where(F.contains("flag", F.lit("D"))).orderBy("ordinal").limit(1)


def heap_map(maps: DataFrame) -> DataFrame:
    return maps.orderBy("end", "ordinal").limit(1)


def map_bases(maps: DataFrame) -> DataFrame:
    """(file, base): the lowest mapping of each file name."""
    return maps.where("path <> ''").groupBy(S.basename(F.col("path")).alias("file")).agg(F.min("start").alias("base"))


def _elf(data: bytes) -> dict:
    """Type, byte order and sections of an ELF file."""
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    kind, at = struct.unpack_from(order + "H", data, 16)[0], struct.unpack_from(order + ("Q" if wide else "I"), data, 40 if wide else 32)[0]
    size, count, names = struct.unpack_from(order + "HHH", data, 58 if wide else 46)
    heads = []
    for i in range(count):
        name, typ, _, addr, offset, length, link = struct.unpack_from(order + ("IIQQQQI" if wide else "IIIIIII"), data, at + i * size)
        heads.append({"name": name, "type": typ, "addr": addr, "offset": offset, "size": length, "link": link})
    strings = heads[names] if names < len(heads) else None
    for h in heads:
        h["name"] = _string(data, strings["offset"] + h["name"]) if strings else ""
    return {"wide": wide, "order": order, "type": kind, "sections": heads}


def _string(data: bytes, at: int) -> str:
    return data[at : data.index(b"\0", at)].decode("utf-8", "replace")


def _raw(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def elf_tables(data: bytes) -> list[tuple]:
    """(kind, name, addr, size, info, base, offset, length, perms) rows of an ELF file.

    Kinds: symbol (defined symbols of .symtab; info is the type), reloc (__cap_relocs), captable (.cap_table; size is its length).
    """
    if data[:4] != b"\x7fELF":
        return []
    elf, rows = _elf(data), []
    for s in elf["sections"]:
        if s["name"] == ".symtab" and s["type"] == 2:
            names, step = elf["sections"][s["link"]]["offset"], 24 if elf["wide"] else 16
            for at in range(s["offset"], s["offset"] + s["size"] - step + 1, step):
                if elf["wide"]:
                    name, info, _, section, value, size = struct.unpack_from(elf["order"] + "IBBHQQ", data, at)
                else:
                    name, value, size, info, _, section = struct.unpack_from(elf["order"] + "IIIBBH", data, at)
                if section:
                    rows.append(("symbol", _string(data, names + name), _raw(value), size, {0: "NOTYPE", 1: "OBJECT", 2: "FUNC"}.get(info & 15, "OTHER"), None, None, None, None))
        elif s["name"] == "__cap_relocs":
            for at in range(s["offset"], s["offset"] + s["size"] - 39, 40):
                target, base, offset, length, perms = (_raw(x) for x in struct.unpack_from(">5Q", data, at))
                rows.append(("reloc", None, target, None, None, base, offset, length, perms))
        elif s["name"] == ".cap_table":
            rows.append(("captable", None, _raw(s["addr"]), s["size"], None, None, None, None, None))
    return [(*r, elf["type"] == 3) for r in rows]


ELF = "file string, path string, kind string, name string, addr long, size long, info string, base long, offset long, length long, perms long, dynamic boolean"


def elf_rows(spark: SparkSession, paths: list[str], maps: DataFrame | None = None) -> DataFrame:
    """Rows of `elf_tables` for binary files; those of shared objects are moved to where `maps` has them first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p.rsplit("/", 1)[-1], p, *r) for p, data in zip(pdf["path"], pdf["content"], strict=True) for r in elf_tables(data)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ELF.split(", ")])

    rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, ELF)
    if maps is None:
        return rows
    moved = rows.join(F.broadcast(map_bases(maps).withColumnRenamed("base", "_at")), "file", "left")  # a row per mapped file
    return moved.withColumn("addr", F.when(F.col("dynamic") & F.col("_at").isNotNull(), F.col("addr") + F.col("_at")).otherwise(F.col("addr"))).drop("_at").select(*[c.split()[0] for c in ELF.split(", ")])


def located(spark: SparkSession, maps: DataFrame, folders: list[str]) -> DataFrame:
    """(file, path): for each mapped file the one of its name in the first of the folders that has it; of `kernel` a `kernel.full` beside it is preferred."""
    ranked = None
    for i, folder in enumerate(folders):
        own = spark.read.format("binaryFile").load(folder).select("path", F.lit(i).alias("rank"))
        ranked = own if ranked is None else ranked.unionByName(own)
    name = S.basename(F.col("path"))
    full = name == "kernel.full"
    found = ranked.select(F.when(full, "kernel").otherwise(name).alias("file"), F.struct("rank", (~full).alias("plain"), "path").alias("_f")).groupBy("file").agg(F.min("_f").alias("_f"))
    return map_bases(maps).select("file").join(found, "file").select("file", "_f.path")


def call_symbols_of(spark: SparkSession, maps: DataFrame, folders: list[str]) -> G.Step:
    """The symbols of called addresses, from the binaries that a memory map names."""
    paths = sorted(r["path"] for r in located(spark, maps, folders).collect())  # a row per mapped file
    return G.call_symbols(symbols(elf_rows(spark, paths, maps))) if paths else lambda g: g


def save_boundaries(files: DataFrame, path: str) -> None:
    """Object files and their bounds (ordinal, objfile, file_base, tops) as lines of JSON."""
    files.select("ordinal", "objfile", "file_base", "tops").write.mode("overwrite").json(path)


def load_boundaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ordinal long, objfile string, file_base long, tops array<long>").json(path)


def symbols(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'symbol'").select("addr", "name", "file", "size", F.col("info").alias("type"))


def relocations(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'reloc'").select(F.col("addr").alias("target"), "base", "offset", "length", "perms", "file")


def captables(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'captable'").select(F.col("addr").alias("start"), (F.col("addr") + F.col("size")).alias("end"), "path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of text files in the order of their bytes."""
    text = spark.read.text(path)
    own = W.partitionBy("_part").orderBy("_place")
    rows = text.select("value", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"))
    return rows.withColumn("_n", F.row_number().over(own)).select(F.col("_place").alias("line_no"), "value")


#: Lines that are counted together; the parts of a file are 2^33 apart.
LINES = 1 << 20


def text_trace(lines: DataFrame) -> DataFrame:
    """(instr, pc, opcode, operands, reg, gpr_val, cap_reg, cap, access, mem_addr): a row per instruction of a text trace.

    lines: (line_no, value).  The lines after an instruction, up to the next, are
    what it wrote and accessed; a capability comes on two lines.
    """
    v = F.col("value")
    x = lambda p, i=1: F.nullif(F.regexp_extract(v, p, i), F.lit(""))
    head = r"^\s*0x([0-9a-fA-F]+):\s+(\S+)\s*(.*?)\s*$"
    reg, cap1, cap2 = r"Write\s+(\w+)\s+=\s+([0-9a-fA-F]{16})", r"Write\s+C(\d+)\|v:(\d)\s+s:(\d)\s+p:([0-9a-fA-F]+)\s+b:([0-9a-fA-F]+)\s+l:([0-9a-fA-F]+)", r"\|o:([0-9a-fA-F]+)\s+t:([0-9a-fA-F]+)"
    mem = r"(?:Cap )?Memory (Read|Write)\s+\[([0-9a-fA-F]+)\]"
    rows = lines.select(
        "line_no", S.parse_hex(x(head)).alias("pc"), x(head, 2).alias("opcode"), F.when(v.rlike(head), F.regexp_extract(v, head, 3)).alias("operands"), x(reg).alias("reg"), S.parse_hex(x(reg, 2)).alias("gpr_val"),
        x(cap1).cast("int").alias("cap_reg"), (x(cap1, 2) == "1").alias("valid"), (x(cap1, 3) == "1").alias("sealed"), S.parse_hex(x(cap1, 4)).bitwiseAND(0xFFFF).alias("perms"), S.parse_hex(x(cap1, 5)).alias("base"), S.parse_hex(x(cap1, 6)).alias("length"),
        S.parse_hex(x(cap2)).alias("offset"), S.parse_hex(x(cap2, 2)).bitwiseAND(0xFFFFFF).alias("otype"), F.lower(x(mem)).alias("access"), S.parse_hex(x(mem, 2)).alias("mem_addr"),
    )
    # lines are numbered by the parts of the files, so a part counts its own instructions and adds those of the parts before
    counted = rows.withColumn("_new", F.col("pc").isNotNull().cast("long"))
    numbered = with_running_sum(counted, [], "line_no", "_new", "instr", float(LINES)).drop("_new").where("instr > 0")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    return numbered.groupBy("instr").agg(*[last(c) for c in rows.columns if c != "line_no"])


def readelf_symbols(lines: DataFrame) -> DataFrame:
    """(objfile, name, addr, size, type) of `readelf -s` output lines (objfile, value)."""
    p = r"^\s*\d+:\s+([0-9a-fA-F]+)\s+(0x[0-9a-fA-F]+|\d+)\s+(FUNC|OBJECT|NOTYPE)\s+\S+\s+\S+\s+(\S+)\s+(\S+)"
    v = F.col("value")
    got = lines.where(v.rlike(p)).select("objfile", F.regexp_extract(v, p, 5).alias("name"), S.parse_hex(F.regexp_extract(v, p, 1)).alias("addr"), S.parse_int(F.regexp_extract(v, p, 2)).alias("size"), F.regexp_extract(v, p, 3).alias("type"), F.regexp_extract(v, p, 4).alias("_section"))
    return got.where("_section <> 'UND'").drop("_section")


def readelf_relocations(lines: DataFrame) -> DataFrame:
    """(objfile, target, base, length, type) of `readelf --cap-relocs` output lines (objfile, value): constants and objects are OBJECT, functions FUNC."""
    p = r"^[ \t]*(0x[0-9a-fA-F]+)\s.*Base: (0x[0-9a-fA-F]+) \(.*\) Length: (\d+) Perms: (Constant|Object|Function)"
    v = F.col("value")
    x = lambda i: F.regexp_extract(v, p, i)
    return lines.where(v.rlike(p)).select("objfile", S.parse_hex(x(1)).alias("target"), S.parse_hex(x(2)).alias("base"), S.parse_int(x(3)).alias("length"), F.when(x(4) == "Function", "FUNC").otherwise("OBJECT").alias("type"))


_LOCATION = "array<struct<type:int,offset:bigint,lowpc:bigint,highpc:bigint,cap_register:int>>"
_VARIABLE = f"array<struct<name:string,size:bigint,type:int,line:int,locations:{_LOCATION},members:array<struct<name:string,offset:bigint,size:bigint>>>>"
DWARF = f"array<struct<name:string,lowpc:bigint,highpc:bigint,variables:{_VARIABLE}>>"


def flat_functions(text: str | None) -> str:
    """Functions of debug information as JSON, the variables of parameters and of blocks of any depth among their own."""
    flat = []
    for f in json.loads(text or "[]"):
        found, blocks = [*(f.get("parameters") or []), *(f.get("variables") or [])], list(f.get("blocks") or [])
        while blocks:
            block = blocks.pop(0)
            found += block.get("variables") or []
            blocks = [*(block.get("blocks") or []), *blocks]
        flat.append({"name": f.get("name"), "lowpc": f.get("lowpc"), "highpc": f.get("highpc"), "variables": found})
    return json.dumps(flat)


def dwarf_functions(docs: DataFrame, text: str = "value", base: Column | None = None) -> DataFrame:
    """(name, lowpc, highpc, variables): functions of debug information; variables of blocks, however deep, join those of the function."""

    @F.pandas_udf("string")
    def flat(texts: pd.Series) -> pd.Series:
        return texts.map(flat_functions)

    f = docs.select(F.explode(F.from_json(flat(F.col(text)), DWARF)).alias("f"), (base if base is not None else F.lit(0)).cast("long").alias("_at"))
    return f.select("f.name", (F.col("f.lowpc") + F.col("_at")).alias("lowpc"), (F.col("f.highpc") + F.col("_at")).alias("highpc"), F.coalesce("f.variables", F.from_json(F.lit("[]"), _VARIABLE)).alias("variables"))


def dwarf_globals(docs: DataFrame, symbols: DataFrame, text: str = "value", base: int = 0) -> DataFrame:
    """(name, addr, size, type): functions and variables of debug information as JSON; a function without an end has the size of the symbol at its address, and goes without one."""
    kind = "struct<functions:array<struct<name:string,lowpc:bigint,highpc:bigint>>,variables:array<struct<name:string,size:bigint,address:bigint>>>"
    d = docs.select(F.from_json(text, kind).alias("d"))
    return _globals(d.select(F.explode("d.functions").alias("f")).select("f.*"), d.select(F.explode("d.variables").alias("v")).select("v.name", F.col("v.address").alias("addr"), "v.size"), symbols, base)


def dwarf_globals_text(lines: DataFrame, symbols: DataFrame, base: int = 0) -> DataFrame:
    """The same from lines of text (value): `codesegment name:..., lowpc: 0x..., highpc: 0x...` and `variable name:..., size:..., at address 0x...`; an unknown size is -1, a variable without an address has none."""
    v = F.col("value")
    segment, variable = r"^codesegment name:(.+), lowpc: 0x([0-9a-fA-F]+), highpc: 0x([0-9a-fA-F]+)", r"^variable name:(.+?), size:(\d+|<unknown>)(?:, at address 0x([0-9a-fA-F]+))?\s*$"
    x = lambda p, i: F.regexp_extract(v, p, i)
    functions = lines.where(v.rlike(segment)).select(x(segment, 1).alias("name"), S.parse_hex(x(segment, 2)).alias("lowpc"), S.parse_hex(x(segment, 3)).alias("highpc"))
    size = F.when(x(variable, 2) == "<unknown>", -1).otherwise(x(variable, 2).try_cast("bigint"))
    return _globals(functions, lines.where(v.rlike(variable)).select(x(variable, 1).alias("name"), S.parse_hex(x(variable, 3)).alias("addr"), size.alias("size")), symbols, base)


def _globals(functions: DataFrame, variables: DataFrame, symbols: DataFrame, base: int) -> DataFrame:
    own = symbols.groupBy("addr").agg(F.max("size").alias("_size"))
    placed = functions.withColumn("addr", F.col("lowpc") + base).join(own, "addr", "left")
    sized = placed.select("name", "addr", F.when(F.col("highpc") == 0, F.col("_size")).otherwise(F.col("highpc") - F.col("lowpc")).alias("size"), F.lit("FUNC").alias("type")).where("size is not null")
    return sized.unionByName(variables.select("name", (F.col("addr") + base).alias("addr"), "size", F.lit("OBJECT").alias("type")))


def annotated(functions: DataFrame, docs: DataFrame, text: str = "value") -> DataFrame:
    """(function, variable, line, expected_length): variables with an annotation of their name and line."""
    kind = "map<string,map<string,struct<line_number:int,expected_length:int>>>"
    notes = docs.select(F.explode(F.from_json(text, kind)).alias("function", "_v")).select("function", F.explode("_v").alias("variable", "_n"))
    notes = notes.select("function", "variable", F.col("_n.line_number").alias("line"), F.col("_n.expected_length").alias("expected_length"))
    own = functions.select(F.col("name").alias("function"), F.explode("variables").alias("v")).select("function", F.col("v.name").alias("variable"), F.col("v.line").alias("line"))
    return own.join(notes, ["function", "variable", "line"])


def overlapping_functions(functions: DataFrame) -> DataFrame:
    """Functions that begin before the one before them ends; empty for sound debug information."""
    before = F.max("highpc").over(W.orderBy("lowpc", "highpc").rowsBetween(W.unboundedPreceding, -1))
    return functions.withColumn("_end", before).where(F.col("lowpc") < F.col("_end")).drop("_end")


def save_graph(g: G.Graph, path: str, name: str | None = None) -> None:
    """One Parquet table for each part, and the display name: that given, the graph's, or the folder's."""
    spark = g.vertices.sparkSession
    for f in fields(g):
        part = getattr(g, f.name)
        if isinstance(part, DataFrame):
            part.write.mode("overwrite").parquet(f"{path}/{f.name}")
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    spark.createDataFrame([(name or g.name or stem,)], "name string").write.mode("overwrite").parquet(f"{path}/meta")


def load_graph(spark: SparkSession, path: str) -> G.Graph:
    parts = {f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(G.Graph) if f.name != "name"}
    return G.Graph(**parts, name=spark.read.parquet(f"{path}/meta").first()["name"])


def tasks(text: str) -> list[tuple[str, list[str]]]:
    """(action, arguments) of the lines of a task file; `#` begins a comment."""
    lines = (line.split("#", 1)[0].split() for line in text.splitlines())
    return [(words[0], words[1:]) for words in lines if words]


def run_tasks(text: str, actions: dict) -> list:
    """Run each task with its action; loaded graphs are shared by path through the actions' own cache."""
    out = []
    for name, arguments in tasks(text):
        if name not in actions:
            raise ValueError(f"unknown action {name!r}; there are {sorted(actions)}")
        out.append(actions[name](*arguments))
    return out


class Graphs:
    """Graphs by path, each read once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def __getitem__(self, path: str) -> G.Graph:
        if path not in self.held:
            self.held[path] = load_graph(self.spark, path)
        return self.held[path]
