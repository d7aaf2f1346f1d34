"""From a search's specification to a DataFrame plan."""
