from lexisift.plans import building as _building  # noqa: F401  registers its queries with the catalogue
from lexisift.plans import learned as _learned  # noqa: F401  likewise
