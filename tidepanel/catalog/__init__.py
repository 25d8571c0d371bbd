"""Query catalogue; ``load`` imports every module once."""

from importlib import import_module

MODULES = ("scalar", "windows", "pointintime", "panelbuild", "evaluation", "inference", "modelling", "risk",
           "portfolio", "screens", "streams", "book", "research")



def load() -> None:
    for m in MODULES:
        import_module(f"tidepanel.catalog.{m}")
