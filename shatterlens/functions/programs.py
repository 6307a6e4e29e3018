"""Candidate programs: static checks, and providers of new ones. Program text is checked, never run."""

from __future__ import annotations

import ast
import hashlib
import json
import textwrap
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# What program text must not contain, in any case, and where it may import from.
FORBIDDEN = (
    "__import__",
    "open(",
    "exec(",
    "eval(",
    "compile(",
    "input(",
    "globals(",
    "locals(",
    "subprocess",
    "socket",
    "requests",
    "urllib",
    "shutil",
    "pathlib",
    "pickle",
    "marshal",
    "ctypes",
    "multiprocessing",
    "threading",
    "os.",
    "sys.",
    "write(",
    "rmdir(",
    "unlink(",
)
IMPORT_ROOTS = frozenset({"math", "heapq", "random", "itertools", "collections", "networkx", "numpy"})


class Finding(NamedTuple):
    """One fault of a program: its line (0 for the whole text), kind and detail."""

    line: int
    kind: str
    detail: str


class _Inspector(ast.NodeVisitor):
    """Collects faults of a syntax tree: strange imports, a missing function, and what stands on top besides definitions."""

    def __init__(self, function: str, strict: bool):
        self.function, self.strict = function, strict
        self.findings: list[Finding] = []

    def visit_Module(self, tree: ast.Module) -> None:
        defined = {x.name for x in tree.body if isinstance(x, ast.FunctionDef)}
        if self.strict:
            if self.function not in defined:
                self.findings.append(Finding(0, "missing", self.function))
            documentation = lambda x: isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant)
            allowed = (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.Assign)
            self.findings += [Finding(x.lineno, "statement on top", type(x).__name__) for x in tree.body if not isinstance(x, allowed) and not documentation(x)]
        self.generic_visit(tree)

    def _imported(self, line: int, module: str) -> None:
        if module.partition(".")[0] not in IMPORT_ROOTS:
            self.findings.append(Finding(line, "import", module))

    def visit_Import(self, node: ast.Import) -> None:
        for name in node.names:
            self._imported(node.lineno, name.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self._imported(node.lineno, node.module or "")


def findings(code: str, function: str = "degree_order", strict: bool = False) -> list[Finding]:
    """All faults of a program, by line; ``strict`` allows only imports, functions, assignments and constants on top."""
    code = textwrap.dedent(code).strip()
    out = [Finding(n, "forbidden", p) for n, line in enumerate(code.lower().splitlines(), 1) for p in FORBIDDEN if p in line]
    try:
        inspector = _Inspector(function, strict)
        inspector.visit(ast.parse(code))
        out += inspector.findings
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        out.append(Finding(getattr(e, "lineno", 0) or 0, "syntax", getattr(e, "msg", None) or type(e).__name__))
    if f"def {function}" not in code:
        out.append(Finding(0, "missing", function))
    return sorted(set(out))


def static_error(code: str, function: str = "degree_order", strict: bool = False) -> str:
    """The first fault as text, '' for a program without one."""
    found = findings(code, function, strict)
    return "" if not found else found[0].kind if found[0].kind == "statement on top" else f"{found[0].kind}: {found[0].detail}"


def forbidden_parts(code: Column) -> Column:
    """ARRAY of the forbidden parts of a program's text, as a column."""
    return F.filter(F.array(*map(F.lit, FORBIDDEN)), lambda p: F.contains(F.lower(code), p))


def checked(programs: DataFrame, key: str, code: str, function: str = "degree_order", strict: bool = False) -> DataFrame:
    """(key, line, kind, detail): one row per fault of a program; NULL code has the one fault ``missing``. Repeated rows count once."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *f) for k, c in zip(pdf["key"], pdf["code"]) for f in findings(c or "", function, strict)]
            yield pd.DataFrame(rows, columns=["key", "line", "kind", "detail"])

    slim = programs.select(F.col(key).alias("key"), F.col(code).alias("code")).distinct()
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInPandas(kernel, f"key {kind}, line int, kind string, detail string").withColumnRenamed("key", key)


def program_id(code: str) -> str:
    return hashlib.sha1(code.encode()).hexdigest()[:12]


class Provider(Protocol):
    """What proposes programs for a prompt; a real one is plugged in from outside."""

    def generate(self, prompt: str, n: int) -> list[str]: ...


class StubProvider:
    """Proposes the plain highest-degree program, the same every time."""

    PROGRAM = "def degree_order(G):\n    return sorted(G, key=lambda u: (-len(G[u]), str(u)))\n"

    def generate(self, prompt: str, n: int) -> list[str]:
        return [self.PROGRAM] * n


class HttpProvider:
    """Asks a chat-completions service at ``url``, again after failures that may pass.

    A refused connection, a timeout, HTTP 429 and 5xx are tried ``tries`` times in all, with waits that
    double from ``wait_s`` up to ``most_wait_s``; other HTTP errors and replies without a text are final.
    """

    def __init__(self, url: str, model: str, key: str = "", tries: int = 4, wait_s: float = 1.0, most_wait_s: float = 30.0, timeout_s: float = 60.0, sleep: Callable[[float], None] = time.sleep):
        self.url, self.model, self.key = url, model, key
        self.tries, self.wait_s, self.most_wait_s, self.timeout_s, self.sleep = tries, wait_s, most_wait_s, timeout_s, sleep

    def _ask(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, body, headers)
        with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
            text = json.load(answer)["choices"][0]["message"]["content"]
        if not isinstance(text, str):
            raise ValueError("a reply without a text")
        return text

    def reply(self, prompt: str) -> str:
        for n in range(self.tries):
            try:
                return self._ask(prompt)
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or n + 1 == self.tries:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if n + 1 == self.tries:
                    raise
            self.sleep(min(self.most_wait_s, self.wait_s * 2**n))
        raise ValueError("tries must be at least 1")

    def generate(self, prompt: str, n: int) -> list[str]:
        return [self.reply(prompt) for _ in range(n)]
