"""`python -m tidemark PATH`: an interactive session on a store."""

import sys

from tidemark.cli import main

sys.exit(main(sys.argv[1:]))
