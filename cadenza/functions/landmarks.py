"""Landmark index dimension (fixed values of the 33-slot skeleton)."""

from __future__ import annotations

# Slot numbers of the skeleton.
NAMES = [
    "nose", "left_eye_inner", "left_eye", "left_eye_outer", "right_eye_inner", "right_eye",
    "right_eye_outer", "left_ear", "right_ear", "mouth_left", "mouth_right", "left_shoulder",
    "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_pinky",
    "right_pinky", "left_index", "right_index", "left_thumb", "right_thumb", "left_hip", "right_hip",
    "left_knee", "right_knee", "left_ankle", "right_ankle", "left_heel", "right_heel",
    "left_foot_index", "right_foot_index",
]
SLOT = {name: i for i, name in enumerate(NAMES)}

LS, RS, LE, RE, LW, RW = 11, 12, 13, 14, 15, 16
LH, RH, LK, RK, LA, RA = 23, 24, 25, 26, 27, 28

# COCO-17 slot -> 33-slot skeleton.
COCO_TO_SLOT = {
    0: 0, 5: LS, 6: RS, 7: LE, 8: RE, 9: LW, 10: RW,
    11: LH, 12: RH, 13: LK, 14: RK, 15: LA, 16: RA,
}

# Joint chains (first, vertex, last) of the eight tracked joints.
JOINTS = {
    "left_knee": (LH, LK, LA), "right_knee": (RH, RK, RA),
    "left_hip": (LS, LH, LK), "right_hip": (RS, RH, RK),
    "left_elbow": (LS, LE, LW), "right_elbow": (RS, RE, RW),
    "left_shoulder": (LE, LS, LH), "right_shoulder": (RE, RS, RH),
}

# Landmark sets of the confidence metrics; two lists mean one per side.
METRIC_CHAINS = {
    "kneeAngle": ((LH, LK, LA), (RH, RK, RA)),
    "hipAngle": ((LS, LH, LK), (RS, RH, RK)),
    "trunkLean": ((LS, RS, LH, RH),),
    "wristStack": ((LW, LE), (RW, RE)),
    "elbowAngle": ((LS, LE, LW), (RS, RE, RW)),
    "shoulderAngle": ((LH, LS, LE), (RH, RS, RE)),
    "ankleSupport": ((LA, RA),),
}

TRUNK = (LS, RS, LH, RH)
LEG = ((LH, LK, LA), (RH, RK, RA))
ARM = ((LS, LE, LW), (RS, RE, RW))
HINGE = ((LS, LH, LK), (RS, RH, RK))
POSE_FLOOR = 0.55
