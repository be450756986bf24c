"""Commands for an engine: a line in, JSON out. `python -m quernel.cli` reads them from standard input.

index ID CONTENT (0: the next free id), search QUERY (find), delete ID (del, rm), stats, save PATH, load PATH, skip rebuild
[TERM], skip stats TERM, clear (cls), help (?), quit (q, exit). Names of commands in any case. An unknown command is answered with up to
three that begin like it.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from quernel.engine import SearchEngine

CLEAR = "\033[2J\033[1;1H"


class Shell:
    def __init__(self, engine: SearchEngine):
        self.engine = engine
        self.commands: dict[str, tuple[Callable[[str], dict | str], str, tuple[str, ...]]] = {
            "index": (self._index, "index ID CONTENT: adds a document", ()),
            "search": (self._search, "search QUERY: the best ten documents", ("find",)),
            "delete": (self._delete, "delete ID: removes a document", ("del", "rm")),
            "stats": (self._stats, "stats: size of the index", ()),
            "save": (self._save, "save PATH: writes a snapshot", ()),
            "load": (self._load, "load PATH: reads a snapshot", ()),
            "skip": (self._skip, "skip rebuild [TERM], skip stats TERM: skip pointers", ()),
            "clear": (lambda _: CLEAR, "clear: empties the screen", ("cls",)),
            "help": (lambda _: {"commands": [text for _, text, _ in self.commands.values()]}, "help: this list", ("?",)),
        }
        self._by_name = {n: f for name, (f, _, others) in self.commands.items() for n in (name, *others)}

    def suggestions(self, start: str, most: int = 3) -> list[str]:
        return [name for name in self.commands if name.startswith(start.lower())][:most]

    def execute(self, line: str) -> str | None:
        """The answer to a line; none if it ends the session. A blank line has an empty one."""
        name, _, rest = line.strip(" \t\r\n").partition(" ")
        name, rest = name.lower(), rest.strip()
        if not name:
            return ""
        if name in ("quit", "q", "exit"):
            return None
        if name not in self._by_name:
            return json.dumps({"error": f"Unknown command: {name}", "suggestions": self.suggestions(name)})
        out = self._by_name[name](rest)
        return out if isinstance(out, str) else json.dumps(out)

    def _index(self, args: str) -> dict:
        number, _, content = args.partition(" ")
        if not number.isdecimal():
            return {"error": "Invalid document ID"}
        if not content.strip():
            return {"error": "Empty content"}
        return {"success": True, "doc_id": self.engine.index_document({"content": content.strip()}, int(number))}

    def _search(self, query: str) -> dict:
        if not query:
            return {"error": "Empty query"}
        found = self.engine.search(query)
        rows = [{"score": round(r.score, 6), "document": {"id": r.doc_id, "content": " ".join(r.fields[k] or "" for k in sorted(r.fields))}} for r in found]
        return {"results": rows, "total": len(rows)}

    def _delete(self, args: str) -> dict:
        return {"success": self.engine.delete_document(int(args))} if args.isdecimal() else {"error": "Invalid document ID"}

    def _stats(self, _: str) -> dict:
        s = self.engine.statistics()
        return {"total_documents": s["n"], "total_terms": s["n_terms"], "avg_doc_length": round(s["avgdl"], 2)}

    def _save(self, path: str) -> dict:
        return {"success": self.engine.save(path)} if path else {"error": "No filepath specified"}

    def _load(self, path: str) -> dict:
        return {"success": self.engine.load(path)} if path else {"error": "No filepath specified"}

    def _skip(self, args: str) -> dict:
        what, _, term = args.partition(" ")
        term = term.strip()
        if what == "rebuild":
            self.engine.rebuild_skip_pointers(term or None)
            return {"success": True, "term": term} if term else {"success": True, "message": "All skip pointers rebuilt"}
        if what == "stats":
            return self.engine.skip_statistics(term) if term else {"error": "No term specified"}
        return {"error": "Unknown skip subcommand"}


def main() -> None:
    from pyspark.sql import SparkSession

    shell = Shell(SearchEngine(SparkSession.builder.getOrCreate()))
    for line in sys.stdin:
        answer = shell.execute(line)
        if answer is None:
            break
        if answer:
            print(answer, flush=True)


if __name__ == "__main__":
    main()
