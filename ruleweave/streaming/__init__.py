"""Events: continuous sessions and structured streams."""
