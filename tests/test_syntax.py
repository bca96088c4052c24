"""Chunks along declarations: scripts, the exact fallback, limits, and symbols in the index."""

from pyspark.sql import functions as F

from corpusmill.operators import chunking, index, segments, syntax

SERVICE = "import x from 'x';\nexport class TokenService {\n  validateRefreshToken() {\n    return true;\n  }\n}\n"
MIXED = """// class Ghost {
import { a } from "b{";
/* function hidden() {
*/
export default async function load(a: string) {
  const s = `}} ${a}
  still text }`;
  return "}" + s; // }
}
const one = 1, two = [
  2,
];
export type Pair = {
  left: number;
};
type Union =
  | "a"
  | "b";
interface Shape { area(): number }

abstract class Box<T> extends Base {
  private size = 3;
  static get width(): number { return 1; }
  method<T>(x: T) {
    if (x) { return { y: 1 }; }
  }
}
console.log("end");
let last = () => {
  return 1;
}
"""


def test_declarations_and_members():
    got = {(a, z): s for a, z, s, _ in syntax.chunks(SERVICE, "typescript-v1")}
    assert got == {(1, 1): None, (2, 2): "TokenService", (3, 5): "TokenService.validateRefreshToken", (6, 6): None}
    assert syntax.regions(MIXED) == [
        (5, 9, "load"), (10, 12, "one"), (13, 15, "Pair"), (16, 18, "Union"), (19, 19, "Shape"), (21, 21, "Box"), (22, 22, "Box.size"), (23, 23, "Box.width"), (24, 26, "Box.method"), (29, 31, "last"),
    ]
    assert [(a, z) for a, z, s, _ in syntax.chunks(MIXED, "tsx-v1") if s is None] == [(1, 4), (27, 28)], "a run of blank lines is no chunk"


def test_every_line_is_covered_once_or_windowed():
    long = "export function f() {\n" + "  g();\n" * 150 + "}\n" + "x\n" * 70
    got = syntax.chunks(long, "typescript-v1")
    assert [(a, z, s) for a, z, s, _ in got] == [(1, 60, "f"), (55, 114, "f"), (109, 152, "f"), (153, 212, None), (207, 222, None)]
    for broken in ("class {", "class A { f( {", "}}}\nfunction g() {}\n", "`open", "/* open", "export default class {\n a() {}\n}"):
        for a, z, _, body in syntax.chunks(broken, "tsx-v1"):
            assert body == "\n".join(syntax.lines_of(broken)[a - 1 : z])


def test_fallback_is_that_of_line_windows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit("lines-v1").alias("parser"))
    extra = spark.createDataFrame([("a", ""), ("b", None), ("c", "\r\n\r\nx\r\n"), ("d", "x\n" * 130), ("e", " \n\t\n")], "id string, text string").withColumn("parser", F.lit("lines-v1"))
    docs = docs.unionByName(extra)
    got = syntax.syntax_chunks(docs, "id", "text", "parser", limited=False)
    want = chunking.line_windows(docs, "id", "text")
    rows = lambda df: sorted((r.id, r.start_line, r.end_line, r.content) for r in df.collect())
    assert rows(got) == rows(want)


def test_files_over_a_limit_say_why(spark):
    texts = {"nul": "a\0b", "line": "a" * 4001, "lines": "x\n" * 12_001, "size": "y" * 100 + "\n" + "z" * 600_000, "chunks": "x\n\n" * 4000 + "function f() {}\n" * 256, "fine": "ok"}
    df = spark.createDataFrame(list(texts.items()), "key string, body string").withColumn("parser", F.lit("typescript-v1"))
    got = {r.key: r.skipped for r in syntax.syntax_chunks(df, "key", "body", "parser").collect()}
    assert got == {"nul": "binary", "line": "line_too_long", "lines": "too_many_lines", "size": "file_too_large", "chunks": "too_many_chunks", "fine": None}
    assert syntax.syntax_chunks(df.limit(0), "key", "body", "parser").collect() == []


def test_symbols_weigh_in_the_index(spark):
    rows = [(1, "src/token.ts", SERVICE), (2, "notes/token.md", SERVICE), (3, "src/other.ts", "// validateRefreshToken is elsewhere\nlet x = 1;\n"), (4, "c.md", "nothing"), (5, "d.md", "at all"), (6, "e.md", "to see")]
    held = segments.Segments(spark, index.shared_folder(spark)).refresh(spark.createDataFrame(rows, "path_id long, path string, text string"))
    best = held.search("validateRefreshToken", 5).collect()
    assert (best[0].path, best[0].start_line, best[0].symbol) == ("src/token.ts", 3, "TokenService.validateRefreshToken")
    assert held.table("contents").count() == 6, "the same bytes are two contents under two parsers"
