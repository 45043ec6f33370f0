"""A menu that asks for what a command needs and runs the command."""

from __future__ import annotations

import glob
import subprocess
import sys
from collections.abc import Callable

CHOICES = ("process files", "search", "chat", "evaluate", "leave")


def parse_selection(text: str, n: int) -> list[int]:
    """Places, from 0, of a choice such as "1,3-5" or "all" among n things; each once, in the order given."""
    text = text.strip().lower()
    if text == "all":
        return list(range(n))
    chosen: list[int] = []
    for part in filter(None, text.replace(",", " ").split()):
        first, dash, last = part.partition("-")
        if not first.isdigit() or (dash and not last.isdigit()):
            raise ValueError(f"{part} is no number or range")
        numbers = range(int(first), int(last if dash else first) + 1)
        if not numbers or numbers[0] < 1 or numbers[-1] > n:
            raise ValueError(f"{part} isn't between 1 and {n}")
        chosen += [i - 1 for i in numbers if i - 1 not in chosen]
    return chosen


def command(mode: str, **flags) -> list[str]:
    """The command line of a mode: lists are spelled out, true flags stand alone, None and False are left out."""
    out = [sys.executable, "-m", "quernlex", mode]
    for name, value in flags.items():
        if value is None or value is False:
            continue
        out.append("--" + name.replace("_", "-"))
        out += [] if value is True else [str(v) for v in value] if isinstance(value, list) else [str(value)]
    return out


class Menu:
    def __init__(self, read: Callable[[str], str] = input, write: Callable[[str], None] = print, start: Callable[[list[str]], object] = subprocess.run, files: str = "*.pdf") -> None:
        self.read, self.write, self.start, self.files = read, write, start, files

    def pick(self) -> list[str]:
        found = sorted(glob.glob(self.files))
        for i, name in enumerate(found, 1):
            self.write(f"{i}. {name}")
        return [found[i] for i in parse_selection(self.read("Files (1,3-5 or all): "), len(found))]

    def chosen(self, number: str) -> list[str] | None:
        """The command for a choice; None where nothing is to run."""
        if number == "1":
            files = self.pick()
            return command("process", pdfs=files) if files else None
        if number == "2":
            text = self.read("Question: ").strip()
            return command("query", query=text, k=int(self.read("Results (10): ").strip() or 10)) if text else None
        if number == "3":
            return command("chat", no_rag=self.read("Use the index (Y/n): ").strip().lower() == "n")
        if number == "4":
            files = self.pick()
            return command("evaluate", pdfs=files or None, num_queries=int(self.read("Questions (100): ").strip() or 100))
        raise ValueError(f"{number} is no choice")

    def run(self) -> None:
        while True:
            for i, name in enumerate(CHOICES, 1):
                self.write(f"{i}. {name}")
            try:
                number = self.read("Choice: ").strip()
                if number == str(len(CHOICES)):
                    return
                todo = self.chosen(number)
            except (EOFError, KeyboardInterrupt):
                return
            except ValueError as e:
                self.write(str(e))
                continue
            if todo:
                self.start(todo)
