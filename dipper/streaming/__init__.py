"""Light curves that arrive over time."""
