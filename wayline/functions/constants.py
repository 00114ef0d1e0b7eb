"""Fixed values of the track contract."""

# seconds
MAX_IDLE, RECENT_WINDOW, HOLD, MAP_TTL, JUST_SEEN, HORIZON = 25.0, 12.0, 0.8, 0.7, 1.5, 0.25
# pixels
MAP_GATE, CENTER_NEAR, MIN_CROP, MIN_MOTION_SCALE = 260.0, 80.0, 24, 40.0
# overlaps and similarities
OVERLAP_IOU, PREVIOUS_IOU, RECENT_LEAST, SIZE_RATIO = 0.35, 0.20, 0.36, 0.35
ACCEPT, ACCEPT_SAME_CAMERA, ACCEPT_FORCED, ACCEPT_APPEARANCE = 0.28, 0.22, 0.20, 0.82
# weights of a pair's score, and bonuses
W_MOTION, W_APPEARANCE, W_MAP, W_TIME, OVERLAP_SHIFT = 0.42, 0.42, 0.10, 0.06, 0.14
BONUS_SAME_CAMERA, BONUS_JUST_SEEN, BONUS_FORCED = 0.10, 0.05, 0.22
# lengths of histories
GALLERY, RING, CACHE, HISTORY = 6, 60, 200, 3
# template update, detector confidence, crop margins (sides, top, bottom)
KEEP, CONFIDENCE = 0.90, 0.55
MARGIN_SIDE, MARGIN_TOP, MARGIN_BOTTOM = 0.18, 0.10, 0.18
# floorplan size, video extensions
MAP_WIDTH, MAP_HEIGHT = 900, 600
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".webm")
