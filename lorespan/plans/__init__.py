"""Multi-step jobs: update, rebuild, search over fresh state."""
