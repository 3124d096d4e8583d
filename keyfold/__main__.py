"""The command line: ``python -m keyfold``."""

from .programs import main

main()
