import sys

from .plans.report import main

sys.exit(main())
