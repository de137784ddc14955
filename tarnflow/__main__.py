"""``python -m tarnflow``."""

from .plans.cli import main

raise SystemExit(main())
