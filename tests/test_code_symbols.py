import re

from lodestone.operators import graph as G

#: the patterns of the system that is followed
REFERENCE = {
    "java": [r"(?m)^\s*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)"],
    "ts": [r"export\s+(?:default\s+)?class\s+(\w+)", r"export\s+(?:async\s+)?(?:const|function)\s+(\w+)", r"export\s+(?:type|interface)\s+(\w+)"],
}
JAVA = "public class Outer {\n  private static final class Inner {\n\t  enum Color { RED }\n  }\n  // class Remark\n}\nnon-sealed class Free {}\n"
TS = "declare module 'a' {\n  export type Shape = { a: number };\n  export default class Deep {}\n}\nnamespace N { export const one = 1; export interface Two {} }\n  class Local {}\nclass Own {}\nexport async function go() {}\n"


def test_nested_symbols(spark):
    rows = [
        ("r", "A.java", "java", JAVA), ("r", "A.kt", "kotlin", "class K {\n    data class Part(val a: Int)\n}"), ("r", "a.ts", "typescript", TS), ("r", "b.js", None, "  export function late() {}"),
        ("r", "a.py", "python", "class P:\n    class Hidden:\n"), ("r", "a.go", "go", "type T struct {\n  type U struct {\nfunc F() {\n  func G() {"), ("r", "c.ts", "typescript", None), (None, None, None, "  class X {"),
    ]
    df = spark.createDataFrame([*rows, rows[0]], "repo string, path string, language string, text string")
    got = sorted((r.path, r.line, r.symbol, r.symbol_kind) for r in G.code_symbols(df).collect())
    assert got == [
        ("A.java", 1, "Outer", "class"), ("A.java", 2, "Inner", "class"), ("A.java", 3, "Color", "enum"), ("A.java", 7, "Free", "class"), ("A.kt", 1, "K", "class"), ("A.kt", 2, "Part", "class"),
        ("a.go", 1, "T", "type"), ("a.go", 3, "F", "function"), ("a.py", 1, "P", "class"),
        ("a.ts", 2, "Shape", "export"), ("a.ts", 3, "Deep", "class"), ("a.ts", 5, "Two", "interface"), ("a.ts", 5, "one", "export"), ("a.ts", 7, "Own", "class"), ("a.ts", 8, "go", "export"), ("b.js", 1, "late", "export"),
    ]
    for ending, text in (("java", JAVA), ("ts", TS)):
        named = {name for pattern in REFERENCE[ending] for name in re.findall(pattern, text)}
        assert named <= {symbol for path, _, symbol, _ in got if path.endswith(ending)}
