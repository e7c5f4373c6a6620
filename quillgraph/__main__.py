"""``python -m quillgraph``."""

from .cli import main

main()
