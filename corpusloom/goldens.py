"""Small inputs for parts that the tables don't hold: addresses, paths, code files and imports."""

from __future__ import annotations

GOLDEN_URLS = [
    "https://github.com/acme/tool", "https://github.com/acme/tool.git", " https://github.com/acme/tool/tree/dev/ ",
    "https://github.com/acme/tool/tree/feature/x", "https://github.com/acme/tool/issues", "https://example.com/acme/tool", "https://github.com/acme", "",
]

GOLDEN_PATHS = ["a/b.TSX", "Jenkinsfile", "tools/Makefile", ".github/Makefile", "Rakefile", ".json", "x.adoc", "x.h", "x", "a.b/c", "README.MD", "src/x.tar.gz"]

GOLDEN_RESPONSES = [(0, "q", " x \n\nq\ny\nz"), (1, "q", None), (2, "how", "how\n  \n"), (3, "a b", "c\nc\nd")]

GRAPH_PATHS = ["src/app/util.py", "app/util.py", "lib/x/__init__.py", "pkg/a.py", "pkg/__init__.py", "__init__.py", "main.py", "web/a.ts", "web/b/index.js", "cmd/run/run.go"]

#: (source, import, language, where it leads)
GOLDEN_IMPORTS = [
    ("main.py", "app.util", "python", "app/util.py"),
    ("main.py", "x", "python", "lib/x/__init__.py"),
    ("pkg/z.py", ".a", "python", "pkg/a.py"),
    ("pkg/a.py", ".", "python", None),
    ("main.py", ".", "python", "__init__.py"),
    ("pkg/a.py", "..", "python", "__init__.py"),
    ("web/a.ts", "./b", "javascript", "web/b/index.js"),
    ("lib/z.js", "../web/a", "javascript", "web/a.ts"),
    ("web/a.ts", "react", "javascript", None),
    ("main.go", "example.com/m/run", "go", "cmd/run/run.go"),
    ("main.go", "fmt", "go", None),
]

GOLDEN_UNITS = [
    ("a.py", "python", "f", "function", "def f(a)", "doc", "def f(a): pass", ["os", "sys"], "about"),
    ("b.go", "go", "block_1", "module", "", "", "", [], "about"),
    ("c.js", "javascript", "C", "class", "class C", "", "class C {}", [f"m{k}" for k in range(13)], ""),
    ("d.x", "generic", "block_2", "module", "", "", "words", ["one"], ""),
]

_PY = 'import os, a.b\nfrom . import x\nfrom ..m import y\ndef f(a: int, *, k=1, **kw) -> str:\n    "doc"\n    return ""\nclass C(B, metaclass=M):\n    def g(self): pass\n'
_JS = "// the app\nimport a from './a'\nconst b = require('b')\n\n// adds\n// numbers\nexport function add(x) {\n  return '}' + x\n}\nclass Box extends Base {\n  put(v) { this.v = v }\n}\nconst twice = (x) => { return 2 * x }\n"
_GO = 'package m\n\nimport (\n\t"fmt"\n\t// "no"\n\tf "x/y"\n)\n\n/* Run runs. */\nfunc (s *Server) Run(a int) {\n\tif a > 0 { fmt.Println("{") }\n}\n\ntype Server struct {\n\tn int\n}\n'
_JAVA = "/* Licence */\nimport a.b.C;\npublic class Box {\n    public int get(int k) {\n        return k;\n    }\n}\n"
_RS = "use std::io;\npub use x::y;\n\n/// Reads.\npub fn read(n: u8) {\n    go();\n}\nimpl Reader {\n    fn inner(&self) {}\n}\n"

GOLDEN_FILES = [
    ("p/a.py", _PY), ("p/bad.py", "import os\ndef f(:\n"), ("p/plain.py", "x = 1\n"), ("p/none.py", "  \n"), ("w/a.js", _JS), ("w/b.ts", "let x = 1\n\nlet y = 2\n"),
    ("g/a.go", _GO), ("j/Box.java", _JAVA), ("r/a.rs", _RS), ("t/a.lua", "-- one\n\n\n\nprint(1)"),
]

#: (path, ord, name, unit_type, signature, docstring, line_start, line_end)
UNITS = [
    ("p/a.py", 0, "f", "function", "def f(a: int, k, **kw) -> str", "doc", 4, 6),
    ("p/a.py", 1, "C", "class", "class C(B)", "", 7, 8),
    ("p/bad.py", 0, "block_1", "module", "", "", 1, 3),
    ("p/plain.py", 0, "plain", "module", "# p/plain.py", "", 1, 1),
    ("w/a.js", 0, "add", "function", "export function add(", "adds\nnumbers", 7, 9),
    ("w/a.js", 1, "Box", "class", "class Box extends Base", "", 10, 12),
    ("w/a.js", 2, "twice", "function", "const twice = (x) =>", "", 13, 13),
    ("w/b.ts", 0, "block_1", "module", "", "", 1, 4),
    ("g/a.go", 0, "Run", "function", "func (s *Server) Run(", "Run runs.", 10, 12),
    ("g/a.go", 1, "Server", "class", "type Server struct {", "", 14, 16),
    ("j/Box.java", 0, "Box", "class", "public class Box", "", 3, 7),
    ("r/a.rs", 0, "read", "function", "pub fn read", "Reads.", 5, 7),
    ("r/a.rs", 1, "Reader", "class", "impl Reader", "", 8, 10),
    ("t/a.lua", 0, "block_1", "module", "", "", 1, 3),
]

#: (path, language, imports, module_doc)
PARSED = [
    ("p/a.py", "python", "os a.b . ..m", ""),
    ("p/bad.py", "python", "", ""),
    ("p/plain.py", "python", "", ""),
    ("p/none.py", "python", "", ""),
    ("w/a.js", "javascript", "./a b", "the app"),
    ("w/b.ts", "typescript", "", ""),
    ("g/a.go", "go", 'fmt f "x/y', ""),
    ("j/Box.java", "java", "a.b.C", "Licence"),
    ("r/a.rs", "rust", "std::io", ""),
    ("t/a.lua", "lua", "", ""),
]
