"""Tables: definitions, the engine that finds them, versioned storage, schema tools, observation."""

from .engine import *  # noqa: F403
from .observe import *  # noqa: F403
from .schema import *  # noqa: F403
from .sqlfile import *  # noqa: F403
from .store import *  # noqa: F403
from .tables import *  # noqa: F403
