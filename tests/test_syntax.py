import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking as K
from quarry.operators import syntax as S

PYTHON = '''"""Module words: def no(): class No:"""
import os
from a.b import (
    c,  # comment )
    d,
)

LIMIT = {"def x": "class Y:"}  # def z():


@cache
@other(
    1)
async def load(path: str = "(", *,
               most=3) -> str:
    """Text
def inside(): it isn't one
"""
    if path:
        def nested():
            return 1

    # a comment

    return nested()


class Box(Base):
    """A box."""
    size = 1

    def __init__(self):
        self.x = \'\'\'
class Fake:
\'\'\'

    @property
    def area(self): return self.x \\
        * 2

    class Inner:
        def deep(self):
            pass

async def last(): pass
print("end")
'''

JAVASCRIPT = """// words: function no() {}
import a, {
  b,
} from "a";
const fs = require('fs');
export { x } from "./x";

const LIMIT = { a: "function f() {", b: /[/}]"{/g };

export default async function load(path, {most = 3} = {}) {
  const t = `text ${path ? `in ${most}}` : "}"} function g() {`;
  if (path) { return t; }
  return most / 2 / 1;
}

const twice = async (x) => {
  return x * 2; /* } */
};
let short = x => x + 1

class Box extends Base {
  size = 1;
  constructor(a,
              b) {
    super(a);
    if (a) { this.a = "}"; }
  }

  static async area(x) {
    return x;
  }
  get name() { return this.n; }
  #hidden() {
    for (const y of z) {
    }
  }
}
console.log("end");
"""


def told(pieces):
    return [(a, b, kind, name) for a, b, _, _, kind, name in pieces]


def test_python_by_hand():
    pieces = S.python_chunks(PYTHON)
    assert told(pieces) == [
        (2, 6, "import", "imports"), (1, 1, "generic", None), (8, 8, "generic", None), (11, 25, "function", "load"), (28, 43, "class", "Box"), (32, 35, "method", "Box.__init__"),
        (37, 39, "method", "Box.area"), (45, 45, "function", "last"), (46, 46, "generic", None),
    ]
    assert pieces[0][3] == ("import os", "from a.b import (\n    c,  # comment )\n    d,\n)")
    raw = PYTHON.split("\n")
    assert all(content == "\n".join(raw[a - 1 : b]) for a, b, content, _, kind, _ in pieces if kind != "import")


def test_javascript_by_hand():
    pieces = S.javascript_chunks(JAVASCRIPT)
    assert told(pieces) == [
        (2, 6, "import", "imports"), (1, 1, "generic", None), (8, 8, "generic", None), (10, 14, "function", "load"), (16, 18, "function", "twice"), (19, 19, "function", "short"), (21, 37, "class", "Box"),
        (23, 27, "method", "Box.constructor"), (29, 31, "method", "Box.area"), (32, 32, "method", "Box.name"), (33, 36, "method", "Box.#hidden"), (38, 38, "generic", None),
    ]
    assert pieces[0][3] == ('import a, {\n  b,\n} from "a";', "const fs = require('fs');", 'export { x } from "./x";')


@pytest.mark.parametrize("cut", [S.python_chunks, S.javascript_chunks])
def test_what_breaks_off_and_what_is_no_code(cut):
    assert cut("") == [] and cut("\n \n") == []
    for text in ("def f(:\n  '''open", "class A {\n `${ {", ")))}}}]]]\nx", "prose, with (no end\nand \"quotes\n\nmore", "/", "`", "\\", "@", "@a\n@b", "import", "class", "function (", "if (a) /b/", "\ttab:\n x"):
        pieces = cut(text)
        lines = {n for a, b, *_ in pieces for n in range(a, b + 1)}
        assert {k for k, x in enumerate(text.split("\n"), 1) if x.strip()} <= lines


def test_as_handlers(spark):
    rows = [(1, "p", "a.py", "import os\nimport re\n\n\ndef f(x):\n    " + "y = x  # much more of it, so that it isn't small\n    " * 3 + "return x\n"), (2, "p", "b.js", JAVASCRIPT), (3, "p", "c.md", "words"), (4, "p", "d.py", "Plain prose. It isn't code at all, but is kept as it stands here.")]
    files = spark.createDataFrame(rows, "id long, project_id string, file_path string, description string")
    got = K.chunk_files(files, S.HANDLERS).orderBy("id", "chunk_index").collect()
    own = [r for r in got if r.id == 1]
    assert [(r.chunk_type, r.name) for r in own] == [("import", "imports"), ("function", "f")] or own[0].how == "combined"
    assert own[-1].content.startswith("import os\nimport re\n\ndef f(x):") and own[-1].how == "context_enriched"
    assert {r.chunk_type for r in got if r.id == 2} >= {"class", "function", "method"}
    assert [(r.chunk_type, r.name) for r in got if r.id == 4] == [("generic", None)]
    stats = {(r.language, r.chunk_type): r.chunks for r in K.chunk_kinds(K.chunk_files(files, S.HANDLERS)).collect()}
    assert stats["python", "function"] == 1 and sum(stats.values()) == len(got)
    broken = K.chunk_files(files, {".py": lambda text: 1 / 0}).where(F.col("file_path") == "a.py")
    assert [r.chunk_type for r in broken.collect()] == ["fallback"]
