import sys

from .plans.stages import main

sys.exit(main())
