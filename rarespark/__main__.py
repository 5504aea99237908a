"""``python -m rarespark``."""

import sys

from rarespark.cli import main

sys.exit(main())
